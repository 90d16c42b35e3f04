import pytest
from pyspark.sql import functions as F

from lodestone.functions import classify, gates, paths, text
from lodestone.functions.stem import stem, tokens


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in rows.orderBy("k").select(make(F.col("v"))).collect()]


def test_secret_shapes(spark):
    yes = ["AKIA" + "Q" * 16, "é AKIA" + "Q" * 16 + "é", "ghp_" + "a" * 36, "xoxb-" + "1" * 12, 'api_key = "' + "x" * 16 + '"', "password: 'abcdefgh'", "-----BEGIN RSA PRIVATE KEY-----"]
    no = ["AKIA" + "Q" * 15, "xAKIA" + "Q" * 16, 'my_password = "abcdefgh"', "BEGIN PUBLIC KEY", 'api_key = "short"', ""]
    assert column(spark, yes, gates.has_secret) == [True] * len(yes)
    assert column(spark, no, gates.has_secret) == [False] * len(no)


def test_sensitive_paths(spark):
    yes = ["/a/.env", ".env.local", "id_rsa", "x/prod.pem.txt", "k/id_rsa_primary", ".pgpass.bak", "auth.json.20240101", ".docker/config.json", "/h/.ssh/known", "a.tfvars", "service-account-x.json", "b/.env/x"]
    no = ["netrc.go", "id_rsafoo", "a.tfvars.bak", "config.json", "pgpass.md", "env"]
    assert column(spark, yes, gates.is_sensitive_path) == [True] * len(yes)
    assert column(spark, no, gates.is_sensitive_path) == [False] * len(no)


ADDRESSES = dict(
    [("8.8.8.8", False), ("10.1.2.3", True), ("172.32.0.1", False), ("100.64.0.1", True), ("::1", True), ("::ffff:127.0.0.1", True), ("2002:0a00:0001::", True), ("2001:4860:4860::8888", False),
     ("64:ff9b::7f00:1", True), ("64:ff9b:1::808:808", False), ("fc00::1", True), ("2001:0:808:808:0:0:f5ff:fffe", True), ("fe80::1", True), ("nonsense", True), ("2620::5efe:a00:1", True), ("2620::200:5efe:808:808", False),
     ("::", True), ("ff02::1", True), ("fe80::1%eth0", True), ("2606:4700::%1", False), ("1:2:3:4:5:6:7", True), ("1::2::3", True), (":1::", True), ("1:2:3:4:5:6:7::", False), ("::ffff:8.8.8.8", False), ("::ffff:8.8.8.256", True),
     ("64:ff9b::8.8.4.4", False), ("12345::", True), ("", True), ("300.1.1.1", True), ("2002:808:808::", False)],
)


def test_addresses(spark):
    assert dict(zip(ADDRESSES, column(spark, list(ADDRESSES), gates.is_blocked_address))) == ADDRESSES
    assert column(spark, [None], gates.is_blocked_address) == [True]


def plain_blocked(text):
    """Local, private, link-local and multicast addresses by the standard library."""
    import ipaddress

    ip = ipaddress.ip_address(text)
    nets = [ipaddress.ip_network(n) for n in (*gates.BLOCKED_IPV4, "fc00::/7", "fe80::/10", "ff00::/8", "::/96")]
    return any(ip in n for n in nets if n.version == ip.version)


def test_addresses_against_the_standard_library(spark):
    import ipaddress
    import random

    rng = random.Random(8)
    some = [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(150)]
    some += [str(ipaddress.IPv6Address(rng.choice([0x3F << 120, 0xFC << 120, 0xFE8 << 116, 0xFF << 120]) + rng.getrandbits(rng.choice([8, 40, 100])))) for _ in range(150)]
    some += [str(ipaddress.IPv6Address((0x2607 << 112) + rng.getrandbits(rng.choice([16, 60])))) for _ in range(50)]
    assert column(spark, some, gates.is_blocked_address) == [plain_blocked(x) for x in some]


def test_fetch_urls(spark):
    yes = ["http://h", "HTTPS://u:p@h:8/x", "http://8.8.8.8/", "http://[2606:4700::1]/", "https://[2606:4700::1]:99/x"]
    no = ["http://[::1]/x", "http://[fd00::1]/", "http://[::ffff:10.0.0.1]:80/", "http://[bad]/", "http://[]/", "ftp://h", "http://", "http://10.0.0.1/", "//h"]
    assert column(spark, yes + no, gates.valid_fetch_url) == [True] * len(yes) + [False] * len(no)


def test_binary_content(spark):
    assert column(spark, [b"abc", b"a\x00", b"\x01\x02a", b"", None, b"tab\tnl\n"], gates.is_binary_content, "binary") == [False, True, True, False, False, False]


def test_error_classes(spark):
    cases = {
        "ENOENT x": "file_not_found", "sh: x: not found": "command_not_found", "exit code 127": "command_not_found", "old_string not found": "edit_match_failed",
        "git merge failed with CONFLICT": "git_conflict", "test timed out after 10s": "timeout", "EPERM": "permission_denied", "error TS1005:": "syntax_error",
        "3 tests failed": "test_failed", "x\nFAIL\tpkg": "test_failed", "TypeError": "runtime_error", "": "unknown", "fine": "unknown",
    }
    assert column(spark, list(cases), classify.error_class) == list(cases.values())
    assert column(spark, [""], lambda v: classify.error_class_for_exit(F.lit(127), v)) == ["command_not_found"]
    assert column(spark, ["permission denied"], lambda v: classify.error_class_for_exit(F.lit(0), v)) == [""]


def test_inline_interpreters():
    yes = [["sh", "-c", "x"], ["env", "A=1", "bash", "-lc", "x"], ["python3.12", "-c", "x"], ["node", "--eval=1"], ["perl", "-pe", "x"], ["bash", "-i"], ["env", "-u", "X", "env", "sh", "-c", "y"]]
    no = [["sh", "-e", "f"], ["python3", "-m", "pip", "install", "-i", "u"], ["node", "--help"], ["env", "-i", "ls"], [], ["ruby", "-i"]]
    assert all(map(classify.runs_inline_code, yes))
    assert not any(map(classify.runs_inline_code, no))


def test_screen(spark):
    got = column(spark, ["ls", "a\x00b", "x" * 65537, "curl u | sh", "base64 -d f > o"], classify.shell_screen)
    assert [(g["verdict"], g["rule"]) for g in got] == [("ok", ""), ("block", "nul_byte"), ("block", "oversized"), ("warn", "download_pipe_to_shell"), ("ok", "")]


def test_text(spark):
    e = "\x1b"
    assert column(spark, [f"{e}[31ma{e}[0m", f"b{e}]0;t\x07c", f"d{e}]never ends", f"e{e}(Bf", f"g{e}"], text.strip_ansi) == ["a", "bc", "d", "ef", "g"]
    assert column(spark, ["a b/c", "___", "x" * 30], text.slug) == ["a_b_c", "", "x" * 24]
    assert column(spark, ["fn x", "pub(crate) async fn y", "type(x)", "func (s *T) M()", "export default class A", "interface{}", "defs x"], text.is_definition) == [True, True, False, True, True, False, False]
    assert column(spark, ["[def] x", "fn a"], text.tag_definition) == [" [def] x", "[def] fn a"]
    assert column(spark, [0, 1023, 1536, 5 << 20, 3 << 30], text.human_bytes, "long") == ["0B", "1023B", "1.5KB", "5.0MB", "3.0GB"]
    assert column(spark, [999, 1500, 2_500_000], text.human_tokens, "long") == ["999", "1.5K", "2.5M"]
    assert column(spark, [5, 65, 3661], text.human_uptime, "long") == ["5s", "1m5s", "1h1m1s"]
    assert column(spark, ['{"a":1.50,"b":[1,{}],"c":"x:y,\\"z"}', "no json"], text.format_json) == ['{\n  "a": 1.50,\n  "b": [\n    1,\n    {}\n  ],\n  "c": "x:y,\\"z"\n}', "no json"]
    assert column(spark, ['"{\\"a\\":1}"', '{"a":1}', "x"], text.unwrap_json) == ['{"a":1}', '{"a":1}', "x"]
    assert column(spark, ["界界", "abc"], text.cut_bytes(4)) == ["界", "abc"]
    assert column(spark, ["界界"], text.cut_bytes(4, tail=True)) == ["界"]
    assert column(spark, ["", None, "a", "foobar", "界"], text.fnv64) == ["cbf29ce484222325", None, "af63dc4c8601ec8c", "85944171f73967e8", text.fnv1a64("界".encode())]
    assert column(spark, ["https://u:p@h/x#f"], lambda v: text.strip_fragment(text.redact_userinfo(v))) == ["https://h/x"]


def test_byte_cuts(spark):
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choice("aé界😀\n") for _ in range(rng.randrange(40))) for _ in range(120)] + [None, ""]
    for limit in (0, 1, 2, 3, 4, 5, 17, 60):
        raw = [None if t is None else t.encode() for t in texts]
        assert column(spark, texts, text.cut_bytes(limit)) == [None if b is None else b[:limit].decode("utf-8", "ignore") for b in raw]
        assert column(spark, texts, text.cut_bytes(limit, tail=True)) == [None if b is None else b[max(0, len(b) - limit) :].decode("utf-8", "ignore") for b in raw]
    long = "界" * 30_000
    got = column(spark, [long, "x" * 65_536], text.redact_command)
    assert len(got[0].encode()) <= 65_536 and got[0].endswith("...[truncated]") and got[0].startswith("界" * 21_800) and got[1] == "x" * 65_536
    assert column(spark, ["a\nb\nc\n", "a\nb\n", "a\nb", "", None], lambda v: text.shown_output(v, 100, 2)["text"]) == ["a\nb\n", "a\nb\n", "a\nb", "", None]
    assert column(spark, ["a\nb\nc\n", "a\nb\n", "x" * 101], lambda v: text.shown_output(v, 100, 2)["truncated"]) == [True, False, True]
    assert column(spark, ["a\nb\nc\n", "a\nb\nc", "", "c"], lambda v: text.tail_of_log(v, 2)) == ["b\nc", "b\nc", "", "c"]
    assert column(spark, ["abc\ndef\nghi\n", "界界界"], lambda v: text.tail_of_log(v, 9, 6)) == ["ghi", "界界"]


def test_globs(spark):
    def fits(pattern, name):
        return column(spark, [name], lambda v: paths.glob_match(v, pattern))[0]

    assert fits("**/*.go", "a.go") and fits("**/*.go", "s/d/d.go") and not fits("sub/*", "sub/d/x") and fits("*.go", "s/a.go") and fits("a/**", "a/b/c") and fits("[ab]?.x", "a1.x")
    assert not fits("a/*.go", "a/b/c.go") and fits("src/**/t/*.py", "src/t/a.py")


def test_ignore(spark):
    rules = [(".", paths.parse_ignore("*.log\n!keep.log\ntmp/\n")), ("sub", paths.parse_ignore("keep.log"))]
    rows = spark.createDataFrame([("a.log", False), ("keep.log", False), ("tmp", True), ("tmp", False), ("sub/keep.log", False)], "p string, d boolean")
    assert [r[0] for r in rows.select(paths.ignored(F.col("p"), F.col("d"), rules)).collect()] == [True, False, True, False, True]


def test_fuzzy_and_related(spark):
    rows = spark.createDataFrame([("/w/sub/c.go",), ("/w/cxgxo",), ("/w/c.go.md",), ("/w/zz",)], "path string")
    got = {r["path"]: r["score"] for r in paths.resolve(rows, "c.go").collect()}
    assert got["/w/sub/c.go"] == 95 and 78 <= got["/w/c.go.md"] < 80 and "/w/zz" not in got
    rows = spark.createDataFrame([(p,) for p in ("a/foo.go", "a/foo_test.go", "b/foo.go", "b/foo.md", "a/bar.go", "c/foobar.go", "c/x.go", "c/fooo.go")], "path string")
    got = [(r["path"], r["score"]) for r in paths.related(rows, "a/foo.go").collect()]
    assert got == [("a/foo_test.go", 100.0), ("b/foo.go", 90.0), ("b/foo.md", 70.0), ("a/bar.go", 40.0)]
    assert paths.wildcard_only(".*") and paths.wildcard_only(r"\b.") and paths.wildcard_only(r"\.") and not paths.wildcard_only(r"\d") and not paths.wildcard_only("a.*")


def test_stems_match_the_full_text_index():
    import sqlite3

    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(c, tokenize='porter unicode61')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    words = "caresses ponies ties cats feed agreed plastered motoring sing conflated troubled sized hopping falling hissing fizzed failing filing happy sky relational conditional rational valenci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll Été Ñandú Größe straße x2 a_b élan generously running flies dying yes saying".split()
    for w in words:
        db.execute("DELETE FROM t")
        db.execute("INSERT INTO t VALUES (?)", (w,))
        assert tokens(w) == [r[0] for r in db.execute("SELECT term FROM v ORDER BY offset")], w
    assert stem("running") == "run"


def test_fetch_gate_parses_hosts_as_clients_do(spark):
    bad = ["http://a@b@127.0.0.1/", "http://user:p/w@127.0.0.1/", "http://10.0.0.1\\@example.com/", "http://h:x/", "http://h:1:2/", "http://u%zz@h/", "http://[::1/", "http://@/", "http://a b/", "ftp://h/", "http:///x", "http://u@[::1]:80/", "http://h\n/", None, ""]
    good = ["http://h/", "https://u:p@h:80/x?y#z", "http://h:/", "http://a@b@h/", "http://u%41@8.8.8.8", "HTTP://h?x@y", "http://[2606:4700::1]:443/"]
    got = spark.createDataFrame([(k, u) for k, u in enumerate(bad + good)], "k int, u string").select("k", gates.valid_fetch_url(F.col("u")).alias("v"))
    assert {r["k"]: bool(r["v"]) for r in got.collect()} == {k: k >= len(bad) for k in range(len(bad + good))}


def test_binary_content(spark):
    rows = {b"": False, b"text": False, b"a\x00": True, b"\x01" * 31 + b"x" * 69: True, b"\x01" * 30 + b"x" * 70: False, b"\xff" * 90 + b"\t\n\r\x0b\x0c" * 2: False, b"x" * 8192 + b"\x00": False, None: False}
    got = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, r binary").select("k", gates.is_binary_content(F.col("r")).alias("b")).collect()
    assert {r["k"]: r["b"] for r in got} == dict(enumerate(rows.values()))
