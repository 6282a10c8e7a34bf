"""Stored web responses: files with a head and a body come in, rows with decoded texts go out. Nothing is fetched."""

from __future__ import annotations

import codecs
import gzip
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as V

HEAD_END = "\r\n\r\n"


def stored_responses(spark: SparkSession, path: str) -> DataFrame:
    """(path, url, final, status, headers, content_type, content_encoding, body) of files that hold one HTTP message each.

    A message is a status line, headers and a body; header names are lower-cased, of repeated ones the last counts. `url` is what
    was asked (header x-asked-url), `final` the address that answered (content-location, else url). A file without a head
    has null in all columns but path; an empty file has no row. Spark lists and splits the files and cuts them; each byte is one character of Latin-1.
    """
    message = spark.read.format("binaryFile").load(path).select("path", "content", F.decode(F.substring("content", 1, 1 << 16), "ISO-8859-1").alias("start"))
    at = F.locate(HEAD_END, F.col("start"))
    message = message.withColumns({"at": at, "head": F.when(at > 0, F.substring(F.col("start"), F.lit(1), at - 1))})
    lines = F.filter(F.slice(F.split("head", "\r\n"), 2, 1 << 16), lambda h: F.instr(h, ":") > 1)
    pairs = F.transform(lines, lambda h: F.struct(F.lower(F.trim(F.substring_index(h, ":", 1))).alias("key"), F.trim(F.substring(h, F.instr(h, ":") + 1, F.length(h))).alias("value")))
    # A map takes a name once: the last of each.
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    body = F.when(F.col("at") > 0, F.substring(F.col("content"), F.col("at") + len(HEAD_END), F.length("content")))
    out = message.select("path", F.map_from_entries(last).alias("headers"), F.regexp_extract("head", r"^HTTP/\S+ (\d{3})", 1).try_cast("int").alias("status"), body.alias("body"))
    header = lambda name: F.try_element_at("headers", F.lit(name))
    url = header("x-asked-url")
    return out.select("path", url.alias("url"), F.coalesce(header("content-location"), url).alias("final"), "status", "headers", header("content-type").alias("content_type"), header("content-encoding").alias("content_encoding"), "body")


def charset_of(content_type: Column) -> Column:
    """The charset that a content type names, lower-cased; UTF-8 if none."""
    named = F.lower(F.regexp_extract(F.coalesce(content_type, F.lit("")), r"""(?i);\s*charset\s*=\s*["']?([^\s;"']+)""", 1))
    return F.when(named == "", "utf-8").otherwise(named)


@F.pandas_udf(T.StringType())
def unpacked(body: pd.Series, encoding: pd.Series, charset: pd.Series, most_text: pd.Series) -> pd.Series:
    """Text of a packed body, null if it does not unpack to at most so many bytes, or if nobody knows its charset.

    gzip without its mark is plain; deflate is tried with a zlib head, then raw.
    """

    def opened(raw: bytes, bits: int, most: int) -> bytes:
        out = []
        while raw:  # a gzip body may have several members
            reader = zlib.decompressobj(bits)
            out.append(reader.decompress(raw, most + 1 - sum(map(len, out))))
            if not reader.eof or sum(map(len, out)) > most:
                raise zlib.error("cut off or too long")
            raw = reader.unused_data.lstrip(b"\0") if bits > zlib.MAX_WBITS else b""
        return b"".join(out)

    def one(raw, how, name, most):
        if raw is None:
            return None
        raw = bytes(raw)
        try:
            codecs.lookup(name)
            if how == "gzip" and raw[:2] == b"\x1f\x8b":
                raw = opened(raw, zlib.MAX_WBITS | 16, most)
            elif how == "deflate":
                try:
                    raw = opened(raw, zlib.MAX_WBITS, most)
                except zlib.error:
                    raw = opened(raw, -zlib.MAX_WBITS, most)
            # Text that Arrow cannot carry (lone surrogates) is replaced like broken bytes.
            return raw.decode(name, "replace").encode("utf-8", "replace").decode("utf-8")
        except (zlib.error, LookupError, UnicodeError, ValueError):
            return None

    return pd.Series([one(*row) for row in zip(body, encoding, charset, most_text, strict=True)], dtype=object)


def decoded(responses: DataFrame, want: str = "html", most_bytes: int = V.RESPONSE_BYTES, most_text: int = 1 << 28) -> DataFrame:
    """responses with `text` and `answer`, without body: what was read of a response, and its status.

    want "html" takes content types with html, "text" those with text/plain or markdown; the text of others is empty, as is that of
    statuses other than 2xx. The first most_bytes bytes count, before unpacking. A body that does not unpack (cut off, broken, over
    most_text bytes, or in an unknown charset) has answer 0 and no text, as has a response without a status. Null bodies are empty. Plain UTF-8 bodies stay
    in the JVM; others go through Python, with their bytes.
    """
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    fits = kind.contains("html") if want == "html" else kind.contains("text/plain") | kind.contains("markdown")
    read = F.coalesce(fits & F.col("status").between(200, 299), F.lit(False))
    encoding, charset = F.lower(F.trim(F.coalesce("content_encoding", F.lit("")))), charset_of(F.col("content_type"))
    raw = F.substring(F.coalesce("body", F.lit(b"")), 1, most_bytes)
    plain = ~encoding.isin("gzip", "deflate") & charset.isin("utf-8", "utf8")
    df = responses.withColumns({"__raw": F.when(read, raw), "__plain": plain})
    df = df.withColumn("__other", unpacked(F.when(~F.col("__plain"), F.col("__raw")), encoding, charset, F.lit(most_text)))
    text = F.when(F.col("__plain"), F.expr("make_valid_utf8(CAST(__raw AS STRING))")).otherwise(F.col("__other"))
    lost = F.col("status").isNull() | (read & text.isNull())
    return df.withColumns({"text": F.coalesce(F.when(read, text), F.lit("")), "answer": F.when(lost, 0).otherwise(F.col("status"))}).drop("body", "__raw", "__plain", "__other")


@F.pandas_udf(T.BinaryType())
def packed(text: pd.Series, encoding: pd.Series, charset: pd.Series) -> pd.Series:
    """The body of a response for a text: encoded in a charset, then gzip, deflate (with head), raw-deflate, or as it is."""

    def one(t, how, name):
        if t is None:
            return None
        raw = t.encode(name, "replace")
        if how == "gzip":
            return gzip.compress(raw, 1, mtime=0)
        if how in ("deflate", "raw-deflate"):
            packer = zlib.compressobj(1, wbits=zlib.MAX_WBITS if how == "deflate" else -zlib.MAX_WBITS)
            return packer.compress(raw) + packer.flush()
        return raw

    return pd.Series([one(*row) for row in zip(text, encoding, charset, strict=True)], dtype=object)
