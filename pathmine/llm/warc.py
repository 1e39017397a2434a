"""WARC derivatives: each response becomes a metadata and a conversion record that refer to it."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
#: What is cut out of a page, what ends a line, and the named characters that are decoded.
HIDDEN = [r"(?s)<!--.*?-->", r"(?is)<script\b.*?(</script\s*>|\z)", r"(?is)<style\b.*?(</style\s*>|\z)", r"(?is)<head\b.*?(</head\s*>|\z)"]
BREAKS = r"(?i)<(br|/?p|/?div|/?li|/?ul|/?ol|/?tr|/?table|/?h[1-6]|/?article|/?section|/?nav|/?header|/?footer|/?title)\b[^>]*>"
NAMED = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&apos;", "'"), ("&reg;", "\u00ae"),
         ("&laquo;", "\u00ab"), ("&raquo;", "\u00bb"), ("&ndash;", "\u2013"), ("&mdash;", "\u2014"), ("&hellip;", "\u2026"), ("&lsquo;", "\u2018"),
         ("&rsquo;", "\u2019"), ("&ldquo;", "\u201c"), ("&rdquo;", "\u201d"), ("&bull;", "\u2022"), ("&euro;", "\u20ac"), ("&agrave;", "\u00e0"),
         ("&eacute;", "\u00e9"), ("&egrave;", "\u00e8"), ("&uuml;", "\u00fc"), ("&ouml;", "\u00f6"), ("&auml;", "\u00e4"), ("&szlig;", "\u00df"),
         ("&ntilde;", "\u00f1"), ("&amp;", "&")]
COMMON = 6
#: A numbered character up to six digits; one that names no character is left as it stands.
NUMBERED = r"&#(?:[0-9]{1,6}|[xX][0-9a-fA-F]{1,6});"
TAG = r"</?[A-Za-z!?][^>]*>"
#: An anchor's address in any of the three quotings; a tag ends at its first ">".
LINK = r"""(?i)<a(?:\s[^>]*?)?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def _uuid(text: Column) -> Column:
    h = F.md5(text)
    return F.concat(F.lit("<urn:uuid:"), *(x for a, n, sep in ((1, 8, "-"), (9, 4, "-"), (13, 4, "-"), (17, 4, "-"), (21, 12, ">"))
                                           for x in (F.substring(h, a, n), F.lit(sep))))


def _sha(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def _numbered(text: Column) -> Column:
    """Numbered characters decoded, but for numbers that name none (0, halves of pairs, over 10FFFF)."""
    said, between = F.regexp_extract_all(text, F.lit(NUMBERED), F.lit(0)), F.split(text, NUMBERED)

    def char(x: Column) -> Column:
        digits = F.regexp_replace(x, "[&#xX;]", "")
        code = F.when(F.lower(x).startswith("&#x"), F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("int")
        good = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        return F.when(good, F.decode(F.unhex(F.lpad(F.hex(F.when(good, code).otherwise(32)), 8, "0")), "UTF-32")).otherwise(x)

    return F.array_join(F.zip_with(between, said, lambda b, x: F.concat(b, F.coalesce(char(x), F.lit("")))), "")


def plain_text(html: Column) -> Column:
    """Visible text: one line per block, blanks collapsed."""
    t = html
    for pattern in HIDDEN:
        t = F.regexp_replace(t, pattern, " ")
    t = F.regexp_replace(F.regexp_replace(t, r"\s+", " "), BREAKS, "\n")
    def decoded(x: Column, names: list) -> Column:
        for name, char in names:
            x = F.replace(x, F.lit(name), F.lit(char))
        return x

    def once(value: Column, body) -> Column:
        """The body of a value that is computed once, however often the body names it."""
        return F.get(F.transform(F.array(value), body), 0)

    t = once(F.regexp_replace(t, TAG, ""), lambda x: F.when(x.contains("&#"), _numbered(x)).otherwise(x))
    # &amp; comes last, and the rarer names are looked for only where another name is left
    t = once(decoded(t, NAMED[:COMMON]), lambda x: F.when(x.rlike("&[b-z]|&a[^m]"), decoded(x, NAMED[COMMON:-1])).otherwise(x))
    t = decoded(t, NAMED[-1:])
    t = F.regexp_replace(F.regexp_replace(t, " +", " "), " ?\n[ \n]*", "\n")
    return F.regexp_replace(t, r"^[ \n]+|[ \n]+\z", "")


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, target_uri, record_id, http_headers, payload): a response record per page row. A null page or address
    is empty. A page that already starts with HTTP/ is split at its first empty line, any other gets headers."""
    d = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.coalesce(F.col(f"`{url_col}`"), F.lit("")).alias("target_uri"),
                     F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("_raw"))
    cut = F.instr("_raw", CRLF * 2)
    whole = F.col("_raw").startswith("HTTP/") & (cut > 0)
    made = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("_raw").cast("string"))
    return d.select(
        "page_id", "target_uri",
        _uuid(F.concat_ws("|", F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), "target_uri", F.md5("_raw"))).alias("record_id"),
        F.when(whole, F.substring("_raw", F.lit(1), cut - 1)).otherwise(made).alias("http_headers"),
        F.when(whole, F.substring("_raw", cut + 4, F.length("_raw"))).otherwise(F.col("_raw")).alias("payload"))


def derivatives(found: DataFrame) -> DataFrame:
    """Two rows per response: its metadata record (warc-fields: source headers, title, outgoing links) and its
    conversion record (plain text). Both carry the response's record id, headers and payload digest. Nothing is
    shuffled; equal responses give equal records; an empty payload gives an empty conversion; a page of any length is one
    row. An empty table gives an empty result."""
    title = F.regexp_replace(F.regexp_extract("payload", r"(?is)<title[^>]*>(.*?)</title", 1), r"\s+", " ")
    links = F.transform(F.regexp_extract_all("payload", F.lit(LINK), F.lit(1)), lambda x: F.regexp_replace(x, "^[\"']|[\"']$", ""))
    fields = F.concat(F.lit("source-headers: "), F.replace(F.col("http_headers"), F.lit(CRLF), F.lit(" | ")), F.lit(f"{CRLF}source-payload-digest: "),
                      F.col("payload_digest"), F.lit(f"{CRLF}title: "), title, F.lit(CRLF),
                      F.array_join(F.transform(links, lambda x: F.concat(F.lit("outlink: "), x, F.lit(CRLF))), ""))
    d = found.withColumn("payload_digest", _sha(F.col("payload")))
    d = d.withColumn("record_type", F.explode(F.array(F.lit("metadata"), F.lit("conversion"))))
    meta = F.col("record_type") == "metadata"
    d = d.select("page_id", "target_uri", F.col("record_id").alias("refers_to"), F.col("http_headers").alias("source_headers"),
                 F.col("payload_digest").alias("source_payload_digest"), "record_type",
                 F.when(meta, "application/warc-fields").otherwise("text/plain; charset=utf-8").alias("content_type"),
                 F.when(meta, fields).otherwise(plain_text(F.col("payload"))).alias("block"))
    return d.select("page_id", "record_type", _uuid(F.concat_ws("|", "record_type", "refers_to")).alias("record_id"), "refers_to", "target_uri",
                    "content_type", "source_headers", "source_payload_digest", _sha(F.col("block")).alias("block_digest"),
                    F.octet_length("block").cast("long").alias("content_length"), "block")


def record_text(d: DataFrame, date: str = "1970-01-01T00:00:00Z") -> Column:
    """A derivative row as a WARC 1.1 record without its closing empty lines; the response's headers stand in
    ``WARC-Source-Headers``, their line ends as `` | ``. ``date``: of the run that made the records."""
    lines = [("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"),
             ("WARC-Block-Digest", "block_digest"), ("WARC-Source-Payload-Digest", "source_payload_digest"), ("Content-Type", "content_type"),
             ("Content-Length", "content_length")]
    head = F.concat(*(x for name, c in lines for x in (F.lit(f"{CRLF}{name}: "), F.col(c).cast("string"))),
                    F.lit(f"{CRLF}WARC-Source-Headers: "), F.replace(F.col("source_headers"), F.lit(CRLF), F.lit(" | ")))
    return F.concat(F.lit(f"WARC/1.1{CRLF}WARC-Date: {date}"), head, F.lit(CRLF * 2), F.col("block"))


def write_warc(d: DataFrame, path: str) -> None:
    """Gzipped WARC files, one per partition."""
    d.select(record_text(d).alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)


def read_warc(spark, path: str) -> DataFrame:
    """(record_type, record_id, refers_to, target_uri, block) of the records in gzipped files, by their lengths."""
    names = {"WARC-Type": "record_type", "WARC-Record-ID": "record_id", "WARC-Refers-To": "refers_to", "WARC-Target-URI": "target_uri"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                data, at, rows = gzip.decompress(content), 0, []
                while (end := data.find(b"\r\n\r\n", at)) >= 0:
                    head = dict(x.split(": ", 1) for x in data[at:end].decode().split(CRLF)[1:])
                    size = int(head["Content-Length"])
                    rows.append([*(head[n] for n in names), data[end + 4:end + 4 + size].decode()])
                    at = end + 4 + size + 4
                yield pd.DataFrame(rows, columns=[*names.values(), "block"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInPandas(run, ", ".join(f"{n} string" for n in [*names.values(), "block"]))


def oracle() -> str:
    """DuckDB SQL for the derivatives of pages that hold no HTTP headers."""
    def uuid(x: str) -> str:
        h = f"md5({x})"
        return "'<urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    t = "payload"
    for p in HIDDEN:
        t = f"regexp_replace({t}, {quoted(p)}, ' ', 'g')"
    t = f"regexp_replace(regexp_replace({t}, '\\s+', ' ', 'g'), {quoted(BREAKS)}, chr(10), 'g')"
    t = f"regexp_replace({t}, {quoted(TAG)}, '', 'g')"
    num = quoted(NUMBERED)
    code = "CASE WHEN lower(x) LIKE '&#x%' THEN CAST('0x' || regexp_replace(x, '[&#xX;]', '', 'g') AS INTEGER) ELSE CAST(regexp_replace(x, '[&#xX;]', '', 'g') AS INTEGER) END"
    char = f"CASE WHEN {code} > 0 AND {code} < 1114112 AND {code} NOT BETWEEN 55296 AND 57343 THEN chr({code}) ELSE x END"
    t = f"""(SELECT CASE WHEN contains(q, '&#') THEN array_to_string(list_transform(list_zip(string_split_regex(q, {num}),
            list_transform(regexp_extract_all(q, {num}), lambda x: {char})), lambda z: z[1] || coalesce(z[2], '')), '') ELSE q END FROM (SELECT {t} AS q))"""
    for name, char in NAMED:
        t = f"replace({t}, {quoted(name)}, {quoted(char)})"
    t = f"regexp_replace(regexp_replace({t}, ' +', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g')"
    t = f"regexp_replace({t}, '^[ \\n]+|[ \\n]+\\z', '', 'g')"
    nl = "chr(13) || chr(10)"
    made = f"'HTTP/1.1 200 OK' || {nl} || 'Content-Type: text/html; charset=utf-8' || {nl} || 'Content-Length: ' || strlen(payload)"
    title = r"regexp_replace(regexp_extract(payload, '(?is)<title[^>]*>(.*?)</title', 1), '\s+', ' ', 'g')"
    bare = f"""regexp_replace(x, {quoted("^[\"']|[\"']$")}, '', 'g')"""
    links = f"""list_aggregate(list_transform(regexp_extract_all(payload, {quoted(LINK)}, 1), lambda x: 'outlink: ' || {bare} || {nl}), 'string_agg', '')"""
    return f"""
WITH p AS (SELECT CAST(page_id AS BIGINT) AS page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload FROM pages),
r AS (SELECT *, {uuid("'response|' || coalesce(page_id::VARCHAR, '') || '|' || target_uri || '|' || md5(payload)")} AS refers_to,
             {made} AS source_headers, 'sha256:' || sha256(payload) AS source_payload_digest FROM p),
b AS (SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type,
             'source-headers: ' || replace(source_headers, {nl}, ' | ') || {nl} || 'source-payload-digest: ' || source_payload_digest || {nl}
             || 'title: ' || {title} || {nl} || coalesce({links}, '') AS block FROM r
      UNION ALL
      SELECT *, 'conversion', 'text/plain; charset=utf-8', {t} FROM r)
SELECT page_id, record_type, {uuid("record_type || '|' || refers_to")} AS record_id, refers_to, target_uri, content_type, source_headers,
       source_payload_digest, 'sha256:' || sha256(block) AS block_digest, CAST(strlen(block) AS BIGINT) AS content_length, block FROM b"""
