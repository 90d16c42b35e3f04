"""Predicates that keep secrets, credentials, binaries and unsafe addresses out of the index.

Boundaries are ASCII look-arounds, not ``\\b``, whose Java meaning depends on Unicode letters.
"""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_START, _END = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"

# Private-key banners and credential shapes.
PRIVATE_KEY_BANNERS = (
    "BEGIN OPENSSH PRIVATE KEY",
    "BEGIN RSA PRIVATE KEY",
    "BEGIN DSA PRIVATE KEY",
    "BEGIN EC PRIVATE KEY",
    "BEGIN ENCRYPTED PRIVATE KEY",
    "BEGIN PRIVATE KEY",
    "BEGIN PGP PRIVATE KEY",
)
AWS_KEY = r"(AKIA|ASIA|ABIA|ACCA)[0-9A-Z]{16}"
GITHUB_TOKEN = r"(gh[pousr]_[A-Za-z0-9_]{36,}|github_pat_[A-Za-z0-9_]{82})"
SLACK_TOKEN = r"xox[baprs]-[0-9A-Za-z]{10,}"
JWT = r"eyJ[A-Za-z0-9\-_=]+\.[A-Za-z0-9\-_=]+\.[A-Za-z0-9\-_.+/=]+"
ASSIGNED_SECRET = (
    r"(?i)(?:^|[^_A-Za-z0-9])(?:aws[_-]?secret[_-]?access[_-]?key|secret[_-]?access[_-]?key|api[_-]?key|access[_-]?token|secret[_-]?key|"
    r"auth[_-]?token|client[_-]?secret|private[_-]?key|refresh[_-]?token|session[_-]?token|id[_-]?token|db[_-]?pass(?:word)?)"
    r"[\t\n\f\r ]*[:=][\t\n\f\r ]*['\"][a-zA-Z0-9_\-.~/!@#$%^&*+=]{16,}['\"]"
)
ASSIGNED_PASSWORD = r"(?i)(?:^|[^_A-Za-z0-9])(?:password|passwd)[\t\n\f\r ]*[:=][\t\n\f\r ]*['\"][^'\"\r\n]{8,}['\"]"

TOKEN_WORDS = ("AKIA", "ASIA", "ABIA", "ACCA", "gho_", "ghp_", "ghs_", "ghu_", "ghr_", "github_pat_", "xox", "eyJ")
ASSIGNED_WORDS = ("secret", "key", "token", "pass")

BINARY_EXTENSIONS = (
    ".png .jpg .jpeg .gif .svg .ico .webp .bmp .pdf .doc .docx .xls .xlsx .ppt .pptx .zip .tar .gz .bz2 .xz .zst .7z .rar "
    ".exe .bin .dll .so .dylib .wasm .o .a .lib .obj .mp3 .mp4 .avi .mov .wav .flac .ogg .ttf .otf .woff .woff2 "
    ".pyc .pyo .class .jar .db .sqlite .sqlite3 .iso .dmg .img"
).split()
SKIPPED_DIRS = ".git node_modules vendor .hg .svn __pycache__ .tox .mypy_cache .pytest_cache dist build .next .nuxt target".split()
SECRET_DIRS = (".aws", ".ssh", ".gnupg", ".kube", ".env")
CREDENTIAL_NAMES = (
    "credentials.json credentials .npmrc .netrc netrc .git-credentials git-credentials .bash_history .zsh_history .pgpass pgpass "
    ".htpasswd antigravity-oauth-token auth.json logins.json plugin-auth.json hosts.yml hosts.yaml"
).split()
HTML_TAGS = "<html </html <head </head <body </body <meta <link <title <script <div <span".split()
# End of fixed values.


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)


def has_private_key(text: Column) -> Column:
    return _any([text.contains(b) for b in PRIVATE_KEY_BANNERS])


def has_secret(text: Column) -> Column:
    """Private-key material or a credential shape anywhere in the text."""
    shapes = [rf"{_START}{p}{_END}" for p in (AWS_KEY, GITHUB_TOKEN, SLACK_TOKEN)]
    # the token may end in a character that is no word character, where a word boundary needs one inside
    jwt = rf"{_START}{JWT}(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
    low = F.lower(text)  # plain searches first: most texts hold none of the words that a shape needs
    token = _any([text.contains(w) for w in TOKEN_WORDS]) & _any([text.rlike(p) for p in (*shapes, jwt)])
    assigned = _any([low.contains(w) for w in ASSIGNED_WORDS]) & _any([text.rlike(p) for p in (ASSIGNED_SECRET, ASSIGNED_PASSWORD)])
    return has_private_key(text) | token | assigned


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def _quote(words) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


def is_sensitive_path(path: Column) -> Column:
    """Credential files by name, their backups (up to eight markers deep), state files, secret folders."""
    low = F.lower(path)
    base = base_name(low)
    credential = (
        r"\.env|\.envrc|\.env\..*|.*\.(?:pem|key|p12|pfx)|.*id_(?:rsa|dsa|ecdsa|ed25519)|id_(?:rsa|dsa|ecdsa|ed25519)(?:[^a-z0-9].*)?|"
        r"service-account.*\.json|" + _quote(CREDENTIAL_NAMES)
    )
    backups = r"(?:\.bak|\.old|\.orig|\.backup|~|\.gpg|\.txt|\.tmp|\.save|\.[0-9]+){0,8}"
    named = base.rlike(rf"(?s)^(?:{credential}){backups}$") | base.rlike(r"\.(?:tfvars|tfstate|kdbx)$")
    docker = (base == "config.json") & low.rlike(r"(?:^|/)\.docker(?:/|$)")
    return named | docker | low.rlike(rf"(?:^|/)(?:{_quote(SECRET_DIRS)})(?:/|$)")


def is_binary_name(name: Column) -> Column:
    return F.lower(name).rlike(rf"(?:{_quote(BINARY_EXTENSIONS)})$")


def has_segment(path: Column, names) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(n) for n in names]))


def in_skipped_dir(path: Column) -> Column:
    return has_segment(path, SKIPPED_DIRS)


def is_binary_content(data: Column) -> Column:
    """A NUL, or over 30 % control bytes, among the first 8192 bytes. Every byte becomes a character of its own, so expressions can count them."""
    head = F.decode(F.substring(data, 1, 8192), "ISO-8859-1")
    control = F.length(head) - F.length(F.regexp_replace(head, r"[\x00-\x08\x0e-\x1f]", ""))
    return F.coalesce((F.length(head) > 0) & (F.contains(head, F.lit("\x00")) | (F.floor(control * 100 / F.greatest(F.length(head), F.lit(1))) > 30)), F.lit(False))


def looks_like_html(body: Column) -> Column:
    """A document opener in the first bytes, or a head or body opener with a second structural tag nearby."""
    text = F.regexp_replace(body, r"^[ \t\n\r]+", "")
    head = F.lower(F.left(text, F.lit(64)))
    window = F.lower(F.left(text, F.lit(512)))
    tags = reduce(lambda a, b: a + b, [window.contains(t).cast("int") for t in HTML_TAGS])
    strong = head.startswith("<!doctype html") | head.startswith("<html")
    return strong | ((head.startswith("<head") | head.startswith("<body")) & (tags >= 2))


def ipv4_number(ip: Column) -> Column:
    """Dotted quad as a number, null if it is none."""
    parts = F.split(ip, r"\.")
    valid = ip.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$")
    value = reduce(lambda acc, k: acc * 256 + F.get(parts, F.lit(k)).cast("long"), range(4), F.lit(0).cast("long"))
    return F.when(valid, value)


# IPv4 ranges that must not be fetched.
BLOCKED_IPV4 = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.168.0.0/16", "198.18.0.0/15", "224.0.0.0/4", "240.0.0.0/4",
)


def is_blocked_ipv4(number: Column) -> Column:
    nets = [ipaddress.ip_network(n) for n in BLOCKED_IPV4]
    return _any([number.between(int(n.network_address), int(n.broadcast_address)) for n in nets])


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once; expressions that name it often do not grow."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ipv6_groups(ip: Column) -> Column:
    """The eight 16-bit numbers of an IPv6 address (without its zone), null if it is none."""
    run = "[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*"

    def numbers(plain: Column) -> Column:
        words = lambda text: F.filter(F.split(text, ":"), lambda w: w != "")
        gap = F.instr(plain, "::") > 0
        left, right = words(F.substring_index(plain, "::", 1)), F.when(gap, words(F.substring_index(plain, "::", -1))).otherwise(F.array().cast("array<string>"))

        def padded(x: Column) -> Column:
            given = F.size(x["l"]) + F.size(x["r"])
            every = F.concat(x["l"], F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - given, F.lit(0))), x["r"])
            return F.when(F.when(gap, given <= 7).otherwise(given == 8), F.transform(every, lambda w: F.conv(w, 16, 10).cast("long")))

        valid = plain.rlike(rf"^(?:{run}|(?:{run})?::(?:{run})?)$")
        return F.when(valid, _let(F.struct(left.alias("l"), right.alias("r")), padded))

    def plainly(bare: Column) -> Column:
        dotted = F.regexp_extract(bare, r":([0-9]+(?:\.[0-9]+){3})$", 1)
        as_hex = lambda n: F.concat(F.hex(F.shiftright(n, 16)), F.lit(":"), F.hex(n.bitwiseAND(0xFFFF)))
        return F.when(dotted == "", bare).otherwise(F.concat(F.regexp_replace(bare, r"[0-9]+(?:\.[0-9]+){3}$", ""), _let(ipv4_number(dotted), as_hex)))

    return _let(_let(F.regexp_replace(ip, "%.*$", ""), plainly), numbers)


def is_blocked_ipv6(groups: Column) -> Column:
    """Local, link-local, private and multicast addresses, and those that hold an IPv4 address that is blocked."""

    def judge(numbers: Column) -> Column:
        g = [F.get(numbers, F.lit(k)) for k in range(8)]
        zero = lambda lo, hi: _all([g[k] == 0 for k in range(lo, hi)])
        v4 = lambda hi, lo: is_blocked_ipv4(hi * 65536 + lo)
        within = lambda mask, value: g[0].bitwiseAND(mask) == value
        holds = _any([
            zero(0, 5) & g[5].isin(0, 0xFFFF),  # compatible and mapped; the loopback lies in 0.0.0.0/8
            (g[0] == 0x64) & (g[1] == 0xFF9B) & g[2].isin(0, 1) & zero(3, 6),  # translated
            g[4].isin(0, 0x200) & (g[5] == 0x5EFE),  # ISATAP
        ])
        return _any([
            holds & v4(g[6], g[7]), within(0xFFC0, 0xFE80), within(0xFF00, 0xFF00), within(0xFE00, 0xFC00),
            (g[0] == 0x2002) & v4(g[1], g[2]),  # 6to4
            (g[0] == 0x2001) & (g[1] == 0) & (v4(g[2], g[3]) | v4(F.lit(0xFFFF) - g[6], F.lit(0xFFFF) - g[7])),  # Teredo: server, and the client inverted
        ])

    return _let(groups, judge)


def is_blocked_address(ip: Column) -> Column:
    """Whether an address, IPv4 or IPv6 with any embedded IPv4, must not be fetched; unparsable ones are blocked."""
    return F.coalesce(F.when(F.instr(ip, ":") > 0, is_blocked_ipv6(ipv6_groups(ip))).otherwise(_let(ipv4_number(ip), is_blocked_ipv4)), F.lit(True))


def valid_fetch_url(url: Column) -> Column:
    """http or https with a host; a literal address must be a public one. Names are not resolved.

    The host stands behind the last ``@`` before the path. A port must be a number or empty, and user information may hold
    letters, digits, escapes and the marks that a URL allows there; anything else is no URL.
    """
    authority = r"(?s)^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))

    def judge(at: Column) -> Column:
        user, place = F.regexp_extract(at, r"(?s)^(.*)@[^@]*$", 1), F.regexp_extract(at, r"(?s)([^@]*)$", 1)
        known_user = ~F.contains(at, F.lit("@")) | user.rlike(r"\A(?:[A-Za-z0-9\-._:~!$&'()*+,;=@]|%[0-9A-Fa-f]{2})*\z")
        host = F.regexp_extract(place, r"\A(\[[^\]]*\]|[^:\[\]]*)(?::[0-9]*)?\z", 1)
        sound = ~host.rlike(r"[\x00-\x20\x7f<>\"\\\\^`{|}]")
        literal = F.when(host.startswith("["), ~_let(F.regexp_replace(host, r"^\[|\]$", ""), is_blocked_address)).otherwise(_let(ipv4_number(host), lambda n: n.isNull() | ~is_blocked_ipv4(n)))
        return known_user & (host != "") & sound & literal

    return scheme.isin("http", "https") & _let(F.regexp_extract(url, authority, 1), judge)
