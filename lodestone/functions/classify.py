"""Rule classifiers: error classes, shell screening, inline interpreters, environment keys."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def error_class(message: Column) -> Column:
    """The first bucket that fits the lower-cased message, else unknown."""
    m = F.lower(F.coalesce(message, F.lit("")))

    def has(*words: str) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | m.contains(w)
        return out

    return (
        F.when(has("enoent", "no such file", "cannot find module", "filenotfounderror"), "file_not_found")
        .when(has("command not found", ": not found", "exited with code 127") | m.rlike(EXIT_127), "command_not_found")
        .when(has("old_string not found", "string to replace not found"), "edit_match_failed")
        .when((has("conflict") & has("merge", "rebase", "git")) | m.startswith("conflict"), "git_conflict")
        .when(has("etimedout", "timed out", "timeout", "deadline exceeded"), "timeout")
        .when(has("eacces", "permission denied", "operation not permitted", "eperm"), "permission_denied")
        .when(has("syntaxerror", "unexpected token", "unexpected end of", "parse error") | m.rlike(TS_ERROR), "syntax_error")
        .when(has("test failed", "tests failed", "assertion") | m.rlike(FAIL_THEN_TEST) | m.rlike(N_TESTS_FAILED) | m.rlike(FAIL_LINE), "test_failed")
        .when(has("typeerror", "referenceerror", "rangeerror", "uncaught exception", "traceback (most recent call last)", "nullpointerexception"), "runtime_error")
        .otherwise("unknown")
    )


def error_class_for_exit(code: Column, output: Column) -> Column:
    """Empty for exit code 0; else the class of the output with its exit code."""
    text = F.coalesce(output, F.lit(""))
    folded = F.concat(F.when(text != "", F.concat(text, F.lit("\n"))).otherwise(""), F.lit("(exited with code "), code.cast("string"), F.lit(")"))
    return F.when(code == 0, F.lit("")).otherwise(error_class(folded))


_S, _E = r"(?<![0-9a-z_])", r"(?![0-9a-z_])"
# Message shapes (of lower-cased text) and shell idioms.
EXIT_127 = _S + r"exit(?:[\t\n\f\r ]+code)?[\t\n\f\r ]*[:=]?[\t\n\f\r ]*127" + _E
TS_ERROR = _S + r"error[\t\n\f\r ]+ts[0-9]{3,5}" + _E
FAIL_THEN_TEST = "(?d)" + _S + r"fail(?:ed)?" + _E + r".*" + _S + "test" + _E
N_TESTS_FAILED = _S + r"[0-9]+[\t\n\f\r ]+tests?[\t\n\f\r ]+failed" + _E
FAIL_LINE = r"(?:^|\n)fail[\t\n\f\r ]"
MAX_COMMAND = 65536
SHELL_WARNINGS = (
    ("base64_pipe_to_shell", r"(?i)base64[\t\n\f\r ]+(?:-d|--decode)[^|\n]{0,120}\|[\t\n\f\r ]*(?:sh|bash|dash|zsh|ksh)(?![0-9A-Za-z_])"),
    ("download_pipe_to_shell", r"(?i)(?<![0-9A-Za-z_])(?:curl|wget)(?![0-9A-Za-z_])[^|\n]{0,120}\|[\t\n\f\r ]*(?:sh|bash|dash)(?![0-9A-Za-z_])"),
    ("redirect_into_sensitive_path", r"(?:>>?)[\t\n\f\r ]*(?:/etc/|/dev/sd[a-z](?![0-9A-Za-z_]))"),
)
# End of fixed values.


def shell_screen(code: Column) -> Column:
    """struct(verdict, rule): block for a NUL or an oversized command, warn for three idioms, else ok."""
    rule = F.when(code.contains("\x00"), "nul_byte").when(F.octet_length(code) > MAX_COMMAND, "oversized")
    for name, pattern in SHELL_WARNINGS:
        rule = rule.when(code.rlike(pattern), name)
    rule = rule.otherwise("")
    verdict = F.when(rule.isin("nul_byte", "oversized"), "block").when(rule != "", "warn").otherwise("ok")
    return F.struct(verdict.alias("verdict"), rule.alias("rule"))


def argv_screen(argv: Column) -> Column:
    """As shell_screen for an argument list, where an oversized one is only a warning."""
    joined = F.array_join(argv, " ")
    rule = F.when(F.exists(argv, lambda a: a.contains("\x00")), "nul_byte").when(F.octet_length(joined) > MAX_COMMAND, "oversized")
    for name, pattern in SHELL_WARNINGS:
        rule = rule.when(joined.rlike(pattern), name)
    rule = rule.otherwise("")
    verdict = F.when(rule == "nul_byte", "block").when(rule != "", "warn").otherwise("ok")
    return F.struct(verdict.alias("verdict"), rule.alias("rule"))


def severity(verdict: Column, rule: Column) -> Column:
    """Worst first: block 3, an idiom's warning 2, an oversized warning 1, ok 0."""
    return F.when(verdict == "block", 3).when((verdict == "warn") & (rule != "oversized"), 2).when(verdict == "warn", 1).otherwise(0)


# Interpreters and the options that carry inline code.
_SHELL = ({"c"}, set(), True)
INTERPRETERS = {
    "sh": _SHELL,
    "bash": _SHELL,
    "dash": _SHELL,
    "zsh": _SHELL,
    "ksh": _SHELL,
    "python": _SHELL,
    "node": ({"e", "p"}, {"--eval", "--print"}, False),
    "nodejs": ({"e", "p"}, {"--eval", "--print"}, False),
    "perl": ({"e", "E"}, set(), True),
    "ruby": ({"e"}, set(), False),
    "php": ({"r"}, set(), False),
    "Rscript": ({"e"}, set(), False),
}
WRAPPERS = ("env", "busybox")
ALLOWED_ENV = (
    "GOFLAGS CGO_ENABLED GOOS GOARCH GOPROXY GOSUMDB GOROOT GOTOOLCHAIN GO111MODULE GOTMPDIR NODE_ENV CI RUST_BACKTRACE "
    "RUSTFLAGS CARGO_TERM_COLOR PYTHONDONTWRITEBYTECODE PYTHONUNBUFFERED TZ LANG LC_ALL"
).split()
DENIED_ENV = (
    "PATH HOME SHELL USER LOGNAME LD_PRELOAD LD_LIBRARY_PATH LD_AUDIT DYLD_INSERT_LIBRARIES DYLD_LIBRARY_PATH DYLD_FRAMEWORK_PATH "
    "IFS CDPATH ENV BASH_ENV SHELLOPTS BASHOPTS SSLKEYLOGFILE TERM"
).split()
SECRET_ENV = r"(?i)token|key|secret|password|passwd|credential|auth|cookie|session"
# End of fixed values.


def _command(argv: list[str]) -> list[str]:
    """The command behind up to four env or busybox wrappers with their options and assignments."""
    for _ in range(4):
        if not argv or os.path.basename(argv[0]) not in WRAPPERS:
            break
        rest = argv[1:]
        while rest:
            head = rest[0]
            if head in ("-i", "-0", "--ignore-environment", "--null") or ("=" in head and not head.startswith("-")):
                rest = rest[1:]
            elif head in ("-u", "--unset", "-C", "--chdir"):
                rest = rest[2:]
            else:
                break
        argv = rest
    return argv


def runs_inline_code(argv, resolved: str = "") -> bool:
    """Whether an argument list hands code to an interpreter on its command line."""
    command = _command([] if argv is None else list(argv))
    if not command:
        return False

    def family(path: str):
        name = os.path.basename(path)
        return INTERPRETERS.get(name) or (INTERPRETERS["python"] if name.startswith("python") else None)

    kind = family(command[0]) or family(resolved)
    if kind is None:
        return False
    short, long, interactive = kind
    options = command[1:]
    for option in options:
        if option.startswith("--"):
            if option.split("=", 1)[0] in long:
                return True
        elif option.startswith("-") and short & set(option[1:]):
            return True
    return interactive and options[:1] == ["-i"] and "-m" not in options


inline_code = F.pandas_udf(lambda s: s.map(runs_inline_code), T.BooleanType())


def allowed_env(env: Column, prefix: str = "") -> Column:
    """Entries of a map<string,string> that a caller may set; ``prefix`` admits more names."""
    ok = lambda k: k.isin(ALLOWED_ENV) | (k.startswith(prefix) if prefix else F.lit(False))
    denied = lambda k: F.upper(k).isin(DENIED_ENV) | F.upper(k).rlike("^(?:LD_|DYLD_)") | k.rlike("[=\\x00]") | (k == "")
    return F.map_filter(env, lambda k, v: ok(k) & ~denied(k))


def child_env(env: Column) -> Column:
    """An inherited environment without names that usually carry secrets."""
    return F.map_filter(env, lambda k, v: k.isin(ALLOWED_ENV) | ~k.rlike(SECRET_ENV))


def is_readonly_role(role: Column, roles) -> Column:
    return role.isin(*roles)


def with_error_class(content: Column, cls: Column) -> Column:
    return F.when(cls == "", content).otherwise(F.concat(F.lit("error_class: "), cls, F.lit("\n"), content))


