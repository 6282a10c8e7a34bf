"""Text functions as SQL fragments, so that they work on columns and inside array lambdas alike."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed_values as V


def lit(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: str, name: str, body: str) -> str:
    """SQL body in which `name` stands for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def java_class(ranges: list[tuple[int, int]]) -> str:
    return "".join(rf"\x{{{a:X}}}" if a == b else rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges)


def once(value: str) -> str:
    """The same value, computed in one place: the optimiser copies no expression that hangs on a random number into filters
    and projections above it, where nested lambdas would multiply. A bare rand() does not do: the optimiser compares it with 0."""
    return f"IF(rand() + 1 < 0, NULL, {value})"


def once_column(value: Column) -> Column:
    return F.when(F.rand() + 1 < 0, F.lit(None)).otherwise(value)


def bounded(df: DataFrame) -> DataFrame:
    """df behind a generator of one row: the optimiser and the planner take what stands above and what stands below it apart,
    where long chains of projections would be merged and gone through again at each of them."""
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def text_slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(first row, end row) of runs of rows of about `most` bytes: what Python makes of a batch is not held for all of it at once."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) if len(texts) else np.zeros(0, np.int64)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + most, "right")))
        yield row, end
        row = end


ZERO_WIDTH = java_class([(c, c) for c in V.ZERO_WIDTH])
BIDI = java_class(V.BIDI_RANGES)
TAGS = java_class([V.TAG_RANGE])
HIDDEN = f"[{ZERO_WIDTH}{BIDI}{TAGS}]"
HIDING = re.compile("[" + "".join(map(chr, V.ZERO_WIDTH)) + "".join(f"{chr(a)}-{chr(b)}" for a, b in [*V.BIDI_RANGES, V.TAG_RANGE]) + "]+")
#: Letters kept apart by single signs: four at least.
SPACED_OUT = re.compile(r"\b(?:\w[.\-_*]){3,}\w\b")


def decode_sql(x: str) -> str:
    """Percent-decoding: UTF-8, broken bytes replaced, broken escapes and plus signs left.

    Spark's url_decode does it for texts of single bytes without broken escapes or bytes; others are taken piece by piece.
    """
    bytes_ = f"transform(regexp_extract_all({x}, '%[0-9A-Fa-f]{{2}}|[^%]+|%', 0), p -> IF(p RLIKE '^%[0-9A-Fa-f]{{2}}$', substring(p, 2, 2), hex(p)))"
    pieces = f"make_valid_utf8(CAST(unhex(array_join({bytes_}, '')) AS STRING))"
    whole = f"IF(octet_length({x}) = char_length({x}), try_url_decode(replace({x}, '+', '%2B')), NULL)"
    return f"IF(instr({x}, '%') = 0, {x}, {let(whole, 'whole', f"IF(whole IS NULL OR contains(whole, '\ufffd'), {pieces}, whole)")})"


def decode_rounds_sql(x: str, rounds: int = V.DECODE_ROUNDS) -> str:
    """Struct (v, n): decoded until nothing changes, and the number of rounds that changed something."""
    step = let(decode_sql("s.v"), "d", "IF(d = s.v, s, named_struct('v', d, 'n', s.n + 1))")
    return f"aggregate(sequence(1, {rounds}), named_struct('v', {x}, 'n', 0), (s, i) -> {step})"


def hidden_kinds_sql(x: str) -> str:
    """Array with the name of each character that does not show, in order."""
    # A text of single bytes has no such character.
    names = " ".join(f"WHEN {code} THEN '{name}'" for code, name in V.ZERO_WIDTH.items())
    code = "conv(hex(encode(c, 'UTF-32')), 16, 10)"
    name = let(f"CAST({code} AS INT)", "o", f"CASE o {names} ELSE IF(o >= {V.TAG_RANGE[0]}, 'UNICODE TAG CHARACTER', concat('BIDI CONTROL U+', lpad(hex(o), 4, '0'))) END")
    return f"transform(IF(octet_length({x}) = char_length({x}), IF({x} IS NULL, NULL, CAST(array() AS array<string>)), regexp_extract_all({x}, {lit(HIDDEN)}, 0)), c -> {name})"


def tag_text_sql(x: str) -> str:
    """What Unicode tag characters spell."""
    chars = f"IF(octet_length({x}) = char_length({x}), CAST(array() AS array<string>), regexp_extract_all({x}, {lit(f'[{TAGS}]')}, 0))"
    return f"array_join(transform({chars}, c -> chr(CAST(conv(hex(encode(c, 'UTF-32')), 16, 10) AS BIGINT) - {V.TAG_RANGE[0]})), '')"


@F.pandas_udf(T.ArrayType(T.StringType()))
def composed(texts: pd.Series) -> pd.Series:
    """NFKC, and letters kept apart by signs joined; Spark has no function for either. Null in, null out."""

    def one(t):
        t = HIDING.sub("", unicodedata.normalize("NFKC", t))
        return SPACED_OUT.sub(lambda m: re.sub(r"[.\-_*]", "", m.group()), t)

    return texts.map(lambda ts: None if ts is None else [None if t is None else one(t) for t in ts])


def normalised(texts: Column) -> Column:
    """Array of normalised texts: composed, hidden characters dropped, white space collapsed, lower case, trimmed.

    Only rows with a text that is not ASCII, or with letters kept apart, go through Python.
    """
    needs = F.exists(texts, lambda t: (F.octet_length(t) != F.char_length(t)) | t.rlike(r"\w[.\-_*]\w[.\-_*]\w[.\-_*]\w"))
    ready = F.coalesce(composed(F.when(needs, texts)), texts)
    return F.transform(ready, lambda t: F.trim(F.lower(F.regexp_replace(t, r"(?U)\s+", " "))))


def base64_texts_sql(x: str) -> str:
    """Array of the texts that base64 runs decode to: UTF-8, over 90% printable, with two words in a row."""
    raw = f"transform(regexp_extract_all({x}, {lit(V.BASE64_RUN)}, 0), b -> try_to_binary(rpad(b, CAST(ceil(length(b) / 4) * 4 AS INT), '='), 'base64'))"
    text = f"transform(filter({raw}, b -> b IS NOT NULL AND is_valid_utf8(CAST(b AS STRING))), b -> CAST(b AS STRING))"
    printable = r"1 - regexp_count(t, '[\\p{C}\\p{Z}&&[^ ]]') / greatest(length(t), 1) > 0.9"
    return f"filter({text}, t -> {printable} AND lower(t) RLIKE '[a-z]{{3,}} [a-z]{{3,}}')"


def prompt_template(prompt: Column) -> Column:
    """Prompts that differ only in addresses are one template."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(prompt, F.lit("")), r"https?://\S+|www\.\S+", "<URL>"), r"(?U)\s+", " ")), 1, V.KEY_CHARS)


def scrubbed(text: Column, site: Column) -> Column:
    """Addresses, domains and the site's own name replaced."""
    bare = F.lower(F.regexp_replace(site, r"^https?://|^www\.|/.*$", ""))
    stem = F.substring_index(bare, ".", 1)
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)https?://\S+|www\.\S+", "<url>")
    out = F.regexp_replace(out, r"(?i)\b(?:[a-z0-9-]+\.)+(?:com|net|org|io|co|ai|app|dev|info|biz|shop|store|site|online|xyz|[a-z]{2})\b", "<domain>")
    named = F.regexp_replace(out, F.concat(F.lit("(?i)"), F.regexp_replace(stem, r"([^\w])", r"\\$1")), F.lit("<site>"))
    return F.trim(F.regexp_replace(F.when(F.length(stem) >= 4, named).otherwise(out), r"(?U)\s+", " "))


def percent(n: Column, d: Column) -> Column:
    return F.when(d == 0, F.lit("n/a")).otherwise(F.format_string("%.1f%%", F.lit(100.0) * n / d))


def unescaped_scripts(html: Column) -> Column:
    """Undo the escapes that hide addresses in inline JSON."""
    for escape, char in (("\\/", "/"), ("\\u0026", "&"), ("\\u003d", "="), ("\\u003f", "?"), ("\\u0025", "%")):
        html = F.replace(html, F.lit(escape), F.lit(char))
    return html


def slices(text: Column, size: int = 2500) -> Column:
    """Array of (n, text): pieces of a long text with the escapes of annotation lines."""
    n = F.ceil(F.length(text) / size).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    piece = lambda i: F.replace(F.replace(F.replace(F.substring(text, (i - 1) * size + 1, F.lit(size)), F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.transform(at, lambda i: F.struct(i.alias("n"), piece(i).alias("text")))
