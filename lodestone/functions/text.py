"""Text, URL, hash and formatting expressions."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .gates import has_secret

ESC = "\x1b"


def strip_ansi(text: Column) -> Column:
    """Without terminal escapes: OSC up to BEL or ST (an open one swallows the rest), CSI, two-byte ones."""
    osc, csi, other = r"\](?:(?s:.*?)(?:\x07|\x1b\\)|(?s:.*)$)", r"\[[\x20-\x3f]*[\x40-\x7e]?", r"[\x20-\x2f]*[\x30-\x7e]?"
    return F.regexp_replace(text, rf"\x1b(?:{osc}|{csi}|{other})", "")


def slug(text: Column, limit: int = 24) -> Column:
    """A label of at most ``limit`` bytes of [A-Za-z0-9_.-]."""
    return F.regexp_replace(F.left(F.regexp_replace(text, r"[^A-Za-z0-9_.\-]", "_"), F.lit(limit)), r"^_+|_+$", "")


def truncate_line(text: Column, limit: int = 500) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("..."))).otherwise(text)


# Words before a definition, and the definition words.
DEF_MODIFIERS = "pub export default async abstract unsafe static protected private public".split()
DEF_KEYWORDS = "struct fn enum trait impl class interface function def func type module object".split()
DEF_MARK = "[def] "


def is_definition(line: Column) -> Column:
    """Modifiers, a definition keyword, blanks, and a name (or a receiver after func)."""
    before = rf"(?:(?:pub\([^)]*\)|(?:{'|'.join(DEF_MODIFIERS)})(?=[ \t]))[ \t]*)*"
    return line.rlike(rf"^[ \t]*{before}(?:(?:{'|'.join(DEF_KEYWORDS)})[ \t]+[\p{{L}}_$]|func[ \t]+\()")


def tag_definition(line: Column) -> Column:
    """Marks definition lines; a literal mark in the content gets a space in front."""
    clean = F.when(line.startswith(DEF_MARK), F.concat(F.lit(" "), line)).otherwise(line)
    short = truncate_line(clean)
    return F.when(is_definition(clean), F.concat(F.lit(DEF_MARK), short)).otherwise(short)


def first_index_token(text: Column) -> Column:
    """The first run of three or more ASCII letters or digits, cut at eight."""
    return F.left(F.regexp_extract(text, r"[A-Za-z0-9]{3,}", 0), F.lit(8))


def strip_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def redact_userinfo(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)(https?://)[^/\s?#]+@", "$1")


def fetch_key(source: Column, kind: Column, url: Column) -> Column:
    return F.concat_ws(":", source, kind, url)


def content_tag(text: Column) -> Column:
    """The first 8 bytes of SHA-256, in hexadecimal."""
    return F.left(F.sha2(text.cast("binary"), 256), F.lit(16))


def _inside_character(raw: Column, place: Column) -> Column:
    """Whether the byte at a place (from 1) continues a character."""
    return F.hex(F.substring(raw, place, F.lit(1))).between("80", "BF")


def cut_bytes(limit: int, tail: bool = False):
    """The first (or last) ``limit`` bytes, never splitting a character."""

    def cut(text: Column) -> Column:
        raw, size = text.cast("binary"), F.octet_length(text)
        first = F.greatest(size - limit + 1, F.lit(1))
        if tail:  # a character has at most three bytes that continue it
            skip = F.lit(3)
            for k in (2, 1, 0):
                skip = F.when(~_inside_character(raw, first + k), k).otherwise(skip)
            part = F.substring(raw, first + skip, size)
        else:
            end = F.lit(max(0, limit - 3))
            for k in (2, 1, 0):
                end = F.when(~_inside_character(raw, F.lit(limit + 1 - k)), max(0, limit - k)).otherwise(end)
            part = F.substring(raw, F.lit(1), end)
        short = F.lit("") if limit <= 0 else part.cast("string")
        return F.when(size > limit, short).otherwise(text)

    return cut


# Limits of one recorded command and of shown output, in bytes and lines, and the mark of a cut.
COMMAND_BYTES, CUT_MARK = 65536, "...[truncated]"
OUTPUT_BYTES, OUTPUT_LINES = 200 * 1024, 2000
TAIL_LINES, MAX_TAIL_LINES, MAX_TAIL_BYTES, LINE_BYTES, MIN_TAIL_READ = 100, 10_000, 4 << 20, 512, 64 << 10
# End of fixed values.


def redact_command(text: Column, limit: int = COMMAND_BYTES) -> Column:
    """Secrets are replaced by a tag of the text; the rest is cut to ``limit`` bytes, the mark of the cut included."""
    redacted = F.concat(F.lit("[redacted sha256:"), content_tag(text), F.lit("]"))
    short = F.concat(cut_bytes(limit - len(CUT_MARK))(text), F.lit(CUT_MARK))
    return F.when(has_secret(text), redacted).when(F.octet_length(text) > limit, short).otherwise(text)


def shown_output(text: Column, max_bytes: int = OUTPUT_BYTES, max_lines: int = OUTPUT_LINES) -> Column:
    """struct(text, truncated): the first lines with their line breaks, then the first bytes of these."""
    head = F.concat(F.substring_index(text, "\n", max_lines), F.lit("\n"))
    first = F.when(F.length(head) < F.length(text), head).otherwise(text)
    return F.struct(cut_bytes(max_bytes)(first).alias("text"), ((F.length(head) < F.length(text)) | (F.octet_length(first) > max_bytes)).alias("truncated"))


def tail_of_log(text: Column, lines: int = TAIL_LINES, max_bytes: int = 0) -> Column:
    """The last lines of a log, of its last ``max_bytes`` bytes if given; a line that this cuts is left out."""
    if not 0 < lines <= MAX_TAIL_LINES or not 0 <= max_bytes <= MAX_TAIL_BYTES:
        raise ValueError("lines or bytes out of range")
    read = max_bytes or min(max(lines * LINE_BYTES, MIN_TAIL_READ), MAX_TAIL_BYTES)
    data = cut_bytes(read, tail=True)(text)
    whole = F.when((F.octet_length(text) > read) & data.contains("\n"), F.regexp_replace(data, r"\A[^\n]*\n", "")).otherwise(data)
    return F.substring_index(F.regexp_replace(whole, r"\n\z", ""), "\n", -lines)


def redact_env_keys(keys: Column, limit: int = 64) -> Column:
    """Distinct sorted names, secret ones tagged, at most ``limit`` and a mark for the rest."""
    clean = F.array_sort(F.array_distinct(F.transform(keys, redact_command)))
    return F.when(F.size(clean) > limit, F.concat(F.slice(clean, 1, limit), F.array(F.lit("…")))).otherwise(clean)


def one_place(x: Column) -> Column:
    """One decimal place, rounded by the exact value and ties to even, as C does; Java rounds the shortest decimal up."""
    return F.pandas_udf(lambda s: s.map("{:.1f}".format, na_action="ignore"), "string")(x)


def human_bytes(n: Column) -> Column:
    k = 1024
    return (
        F.when(n >= k**3, F.concat(one_place(n / k**3), F.lit("GB")))
        .when(n >= k**2, F.concat(one_place(n / k**2), F.lit("MB")))
        .when(n >= k, F.concat(one_place(n / k), F.lit("KB")))
        .otherwise(F.concat(n.cast("long").cast("string"), F.lit("B")))
    )


def human_tokens(n: Column) -> Column:
    return (
        F.when(n >= 1_000_000, F.concat(one_place(n / 1_000_000), F.lit("M")))
        .when(n >= 1_000, F.concat(one_place(n / 1_000), F.lit("K")))
        .otherwise(n.cast("long").cast("string"))
    )


def human_uptime(seconds: Column) -> Column:
    s = seconds.cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(h > 0, F.concat(h, F.lit("h"), m, F.lit("m"), r, F.lit("s"))).when(m > 0, F.concat(m, F.lit("m"), r, F.lit("s"))).otherwise(F.concat(r, F.lit("s")))


def size_tag(n: Column) -> Column:
    return F.when(n >= 20480, F.concat(F.floor((n + 512) / 1024).cast("string"), F.lit("KB"))).otherwise(F.lit(""))


def estimated_tokens(n: Column) -> Column:
    return n / 4.0


def round_score(v: Column) -> Column:
    return F.floor(v * 10 + 0.5) / 10


def fnv1a64(raw: bytes) -> str:
    h = 0xCBF29CE484222325
    for b in raw:
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"


@F.arrow_udf(T.StringType())
def fnv64(texts: pa.Array) -> pa.Array:
    """FNV-1a of 64 bits in hexadecimal: byte by byte, but of all texts of a batch at once, the longest first, where they lie in the batch."""
    texts = texts.cast(pa.large_string())
    _, offsets, bytes_ = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(bytes_ or b"", np.uint8)
    order = np.argsort(at[:-1] - at[1:], kind="stable")
    sizes, start = np.diff(at)[order], at[:-1][order]
    h, longer = np.full(len(order), 0xCBF29CE484222325, np.uint64), len(order)
    for k in range(int(sizes[0]) if len(order) else 0):
        while sizes[longer - 1] <= k:
            longer -= 1
        h[:longer] = (h[:longer] ^ data[start[:longer] + k]) * np.uint64(0x100000001B3)
    back = np.empty_like(h)
    back[order] = h
    return pa.array([None if gone else f"{int(x):016x}" for x, gone in zip(back, texts.is_null().to_pylist(), strict=True)], pa.string())


def _indent(text: str) -> str:
    """Indented JSON with numbers and key order as written; anything else unchanged."""
    try:
        json.loads(text)
    except ValueError:
        return text
    out, depth, k, n = [], 0, 0, len(text)
    while k < n:
        ch = text[k]
        if ch == '"':
            end = k + 1
            while text[end] != '"':
                end += 2 if text[end] == "\\" else 1
            out.append(text[k : end + 1])
            k = end + 1
            continue
        if ch in "{[":
            rest = k + 1
            while text[rest] in " \t\r\n":
                rest += 1
            if text[rest] in "}]":
                out.append(ch + text[rest])
                k = rest + 1
                continue
            depth += 1
            out.append(ch + "\n" + "  " * depth)
        elif ch in "}]":
            depth -= 1
            out.append("\n" + "  " * depth + ch)
        elif ch == ",":
            out.append(",\n" + "  " * depth)
        elif ch == ":":
            out.append(": ")
        elif ch not in " \t\r\n":
            out.append(ch)
        k += 1
    return "".join(out)


format_json = F.udf(lambda x: None if x is None else _indent(x), T.StringType(), useArrow=False)


def _unwrap(text: str, depth: int = 3) -> str:
    """JSON that is wrapped in up to three JSON strings; anything else unchanged."""
    value = text
    for _ in range(depth):
        try:
            inner = json.loads(value)
        except (ValueError, TypeError):
            return text
        if isinstance(inner, dict):
            return value
        if not isinstance(inner, str):
            return text
        value = inner
    try:
        return value if isinstance(json.loads(value), dict) else text
    except ValueError:
        return text


unwrap_json = F.pandas_udf(lambda s: s.map(lambda x: None if x is None else _unwrap(x)), T.StringType())


@F.pandas_udf(T.StringType())
def valid_utf8(raw: pd.Series) -> pd.Series:
    """Bytes as text, each invalid sequence one replacement character."""
    return raw.map(lambda b: None if b is None else bytes(b).decode("utf-8", "replace"))
