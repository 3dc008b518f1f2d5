"""Queries over the reference tables, with equivalent SQL where SQL can express them.

No table holds PDF files, so rows are written as PDFs on the way (in all the ways that the
writer knows) or words are laid out as positioned chunks; both are deterministic. What the
queries then run are the engine's own operators.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import encodings, filters, syntax
from .functions.crypto import aes_cbc, rc4
from .operators import relational
from .plans import extract, layout
from .session import reach_workers
from .sources.pdf import read_pdfs, write_files
from .sources.writer import LINES_A_PAGE, PdfWriter, encrypt_entry, escaped, file_key, object_key, rc4_encrypt, simple_pdf, text_pdf
from .storage import removed_at_exit, scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return reach_workers(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: Partitions that files are made in, at least.
LEAST_PARTS = 48


#: Bytes of a file for a partition of texts, which grow many times as they become words or files.
BYTES_A_PART = 8 << 20


def _spread_texts(docs: DataFrame, *keys: str) -> DataFrame:
    """``_spread`` of a table, in more partitions if it is large."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return docs.repartition(max(4 * docs.sparkSession.sparkContext.defaultParallelism, LEAST_PARTS, min(size // BYTES_A_PART, 4096)), *keys)


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` in enough partitions, by ``keys`` or evenly, for all cores to take part. Rows are
    small next to the work that files made of them need, so partitions that are cut by bytes
    (of a file, or by Spark as it merges shuffled ones) would leave it to few tasks."""
    return df.repartition(max(4 * df.sparkSession.sparkContext.defaultParallelism, LEAST_PARTS), *keys)


def as_pdfs(docs: DataFrame, **how) -> DataFrame:
    """path, content: every document (doc_id, text) as a PDF file, written as ``how`` says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 16):
                texts = b.column(1).slice(lo, 16).to_pylist()
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, 16), pa.array([text_pdf(t or "", **how) for t in texts], pa.binary())], ["path", "content"])

    return _spread_texts(docs.select(F.col("doc_id").cast("string"), "text")).mapInArrow(run, "path string, content binary")


def as_chunks(docs: DataFrame) -> DataFrame:
    """Chunks of every document: its words in rows of ten, forty rows a page."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+"), F.lit(0))
    # texts are moved, not their words: all rows of a document, and so of a layer, stay together
    w = _spread_texts(docs.select("doc_id", "text"), "doc_id").select("doc_id", F.posexplode(words).alias("i", "text"))
    n, row, col = F.char_length("text"), F.floor(F.col("i") / 10), F.col("i") % 10
    x0 = 36 + col * 60 + (F.col("i") % 4) * 0.25
    y0 = 700 - (row % 40) * 14 - (F.col("i") % 3) * 0.25
    return w.select(
        "doc_id", F.floor(row / 40).cast("int").alias("page_no"), F.lit(0).cast("tinyint").alias("part"), F.lit(0).alias("layer_no"), F.col("i").alias("seq"),
        x0.cast("float").alias("x0"), y0.cast("float").alias("y0"), (x0 + F.least(n, F.lit(9)) * 6).cast("float").alias("x1"), (y0 + 10).cast("float").alias("y1"),
        "text", n.alias("string_len"),
    )


_SPACES = r"[^ \t\n\x0B\f\r]+"
_CHUNKS = f"""
words AS (
  SELECT doc_id, text, i - 1 AS i FROM (
    SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{_SPACES}')) AS text,
           generate_subscripts(regexp_extract_all(coalesce(text, ''), '{_SPACES}'), 1) AS i FROM documents)
), chunks AS (
  SELECT doc_id, CAST(i // 400 AS INTEGER) AS page_no, i AS seq, text, length(text) AS string_len,
         36 + (i % 10) * 60 + (i % 4) * 0.25::DOUBLE AS x0, 700 - ((i // 10) % 40) * 14 - (i % 3) * 0.25::DOUBLE AS y0,
         36 + (i % 10) * 60 + (i % 4) * 0.25::DOUBLE + least(length(text), 9) * 6 AS x1, 710 - ((i // 10) % 40) * 14 - (i % 3) * 0.25::DOUBLE AS y1
  FROM words
), lagged AS (
  SELECT *, lag(x0) OVER w AS px0, lag(y0) OVER w AS py0, lag(x1) OVER w AS px1, lag(y1) OVER w AS py1, lag(string_len) OVER w AS pn
  FROM chunks WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY seq)
), flagged AS (
  SELECT *, CASE WHEN px0 IS NOT NULL AND ((trunc(py0) = trunc(y0) AND trunc(py1) = trunc(y1)) OR
    (y0 <= py1 AND py0 <= y1 AND least(py1 - py0, y1 - y0) * 0.5 < least(abs(py0 - y1), abs(py1 - y0)) AND
     (CASE WHEN x0 <= px1 AND px0 <= x1 THEN 0 ELSE least(abs(px0 - x1), abs(px1 - x0)) END)
       < greatest((px1 - px0) / pn, (x1 - x0) / string_len) * 2)) THEN 0 ELSE 1 END AS opens
  FROM lagged
), numbered AS (
  SELECT *, CAST(sum(opens) OVER (PARTITION BY doc_id, page_no ORDER BY seq) - 1 AS INTEGER) AS line_no FROM flagged
), pieces AS (
  SELECT *, CASE WHEN lag(x1) OVER (PARTITION BY doc_id, page_no, line_no ORDER BY seq)
                   < x0 - greatest(y1 - y0, (x1 - x0) / string_len) * 0.1 THEN ' ' ELSE '' END || text AS piece FROM numbered
), lines AS MATERIALIZED (
  SELECT doc_id, page_no, line_no, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1,
         string_agg(piece, '' ORDER BY seq) AS text, CAST(sum(string_len) AS INTEGER) AS string_len
  FROM pieces GROUP BY doc_id, page_no, line_no
)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.lines(as_chunks(_table(spark, sf_dir, "documents")))


def _doubles(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast("double").alias(f.name) if f.dataType.simpleString() == "float" else F.col(f.name) for f in df.schema])


def _mapped(df: DataFrame, run: Callable[[bytes], object], name: str = "text", kind: str = "string") -> DataFrame:
    """doc_id and ``run`` of every document's bytes, in Arrow batches."""
    arrow = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[kind]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [(t or "").encode() for t in b.column(1).to_pylist()]
            out = [run(r) for r in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.decode() if isinstance(x, bytes) else x for x in out], arrow)], ["doc_id", name])

    return df.select("doc_id", "text").mapInArrow(each, f"doc_id long, {name} {kind}")


def _files(df: DataFrame, make: Callable[..., bytes]) -> DataFrame:
    """path (the first column) and content: a PDF file made from the others of every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                key, *rest = (b.column(i).slice(lo, 64).to_pylist() for i in range(b.num_columns))
                yield pa.RecordBatch.from_arrays([pa.array(map(str, key), pa.string()), pa.array([make(*r) for r in zip(*rest)], pa.binary())], ["path", "content"])

    return df.mapInArrow(each, "path string, content binary")


#: Documents written in other ways and read back, by query: how they are written.
ROUND_TRIPS: dict[str, dict] = {
    "pdf_xref_streams": {"xref": "stream", "pack": True},
    "pdf_revisions": {"revise": True},
    "pdf_recovered": {"shift": 7},
    "pdf_literal_strings": {"literal": True},
    "pdf_show_arrays": {"show": "array"},
    "pdf_leading": {"show": "lead"},
    "pdf_next_line": {"show": "quote"},
    "pdf_spaced_next_line": {"show": "quotes"},
    "pdf_matrices_and_images": {"show": "matrix"},
    "pdf_forms": {"wrap": "form"},
    "pdf_annotations": {"wrap": "annotation"},
    "pdf_hex_streams": {"store": "hex"},
    "pdf_lzw_streams": {"store": "lzw"},
    "pdf_ascii85_streams": {"store": "ascii85"},
    "pdf_rc4_40": {"cipher": "rc4-40"},
    "pdf_rc4_128": {"cipher": "rc4-128"},
    "pdf_code_ranges": {"font": "ranges"},
    "pdf_differences": {"font": "differences"},
    "pdf_charset": {"font": "utf16"},
    "pdf_truetype": {"font": "truetype"},
    "pdf_truetype_segments": {"font": "segments"},
    "pdf_type3": {"font": "type3"},
}
#: The double quote shows a literal's raw bytes in ``compat``, as the engine replaced here does.
_STANDARD = {"pdf_spaced_next_line"}


def _round_trip(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = extract.extract_text(as_pdfs(_table(spark, sf_dir, "documents"), **ROUND_TRIPS[name]), compat=name not in _STANDARD)
        return got.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    run.__name__, run.__doc__ = name, f"Documents written with {ROUND_TRIPS[name]} and read back."
    return run


def pdf_aes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose streams Spark's own function encrypts, as files of revision 4."""
    key, iv, number = file_key(4, 16), bytes(range(16)), 4
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    codes = F.transform(F.split("text", "\n"), lambda x: F.when(x == "", F.lit("")).otherwise(F.concat(F.lit("<"), F.hex(F.encode(x, "UTF-16BE")), F.lit("> Tj"))))
    content = F.concat(F.lit("BT /F1 10 Tf 36 36 Td "), F.array_join(codes, " 0 -14 Td "), F.lit(" ET "))
    sealed = docs.select("doc_id", F.aes_encrypt(content, F.lit(object_key(key, number, aes=True)), F.lit("CBC"), F.lit("PKCS"), F.lit(iv)).alias("raw"))

    def make(raw: bytes) -> bytes:
        w = PdfWriter()
        tree, inner = w.reserve(), w.add(b"<< /Type /Font /Subtype /CIDFontType0 /BaseFont /Any /DW 600 >>")
        face = w.add(b"<< /Type /Font /Subtype /Type0 /BaseFont /Any /Encoding /UniGB-UTF16-H /DescendantFonts [%d 0 R] >>" % inner)
        assert w.stream(raw) == number
        page = w.add(b"<< /Type /Page /Parent %d 0 R /MediaBox [0 0 612 792] /Resources << /Font << /F1 %d 0 R >> >> /Contents %d 0 R >>" % (tree, face, number))
        w.add(b"<< /Type /Pages /Count 1 /Kids [%d 0 R] >>" % page, tree)
        return w.finish(w.add(b"<< /Type /Catalog /Pages %d 0 R >>" % tree), extra=encrypt_entry(4, 16, aes=True))

    got = extract.extract_text(_files(_spread(sealed), make))
    return got.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def pdf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of files, one a nation, read as a source."""
    folder = scratch(spark, "nations")
    nations = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()  # a small table
    write_files(spark, folder, {f"{r['n_nationkey']}.pdf": text_pdf(r["n_name"]) for r in nations})
    removed_at_exit(spark, folder)
    got = extract.extract_text(read_pdfs(spark, folder))
    return got.select(F.regexp_extract("doc_id", r"(\d+)\.pdf$", 1).cast("int").alias("n_nationkey"), "text")


#: Predefined character maps with the codec that spells their strings here.
CHARSETS = [
    ("GBK-EUC-H", "gbk"), ("GB-EUC-H", "gb2312"), ("GBK2K-H", "gb18030"), ("B5pc-H", "big5"), ("90ms-RKSJ-H", "shift_jis"), ("EUC-H", "euc_jp"), ("KSC-EUC-H", "euc_kr"), ("KSCms-EUC-H", "cp949"),
    ("H", "iso2022_jp"), ("KSC-H", "iso2022_kr"), ("UniJIS-UCS2-H", "utf-16-be"), ("UniKS-UTF32-H", "utf-32-be"), ("UniCNS-UTF8-H", "utf-8"), ("Identity-H", "utf-16-be"),
]


def pdf_charsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with two characters that all of these charsets hold before their names: a
    file a nation, a predefined character map a key."""
    n = _table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_nationkey").alias("key"), F.concat(F.lit("日本"), "n_name").alias("name"))

    def make(key: int, name: str) -> bytes:
        charset, codec = CHARSETS[key % len(CHARSETS)]
        font = b"/Type /Font /Subtype /Type0 /BaseFont /K /Encoding /%s /DescendantFonts [<< /Type /Font /Subtype /CIDFontType0 /DW 500 >>]" % charset.encode()
        return simple_pdf([b"BT /F1 10 Tf 10 700 Td <%s> Tj ET " % name.encode(codec).hex().encode()], font=font)

    got = extract.extract_text(_files(n, make))
    return got.select(F.col("doc_id").cast("int").alias("n_nationkey"), "text")


def pdf_vertical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text that runs downwards isn't shown."""
    n = _spread(_table(spark, sf_dir, "customer").select("c_custkey", "c_name"))
    font = b"/Type /Font /Subtype /Type0 /BaseFont /K /Encoding /Identity-V /DescendantFonts [<< /Type /Font /Subtype /CIDFontType0 >>]"
    got = extract.extract_text(_files(n, lambda name: simple_pdf([b"BT /F1 10 Tf 10 700 Td <%s> Tj ET " % name.encode("utf-16-be").hex().encode()], font=font)))
    return got.select(F.col("doc_id").cast("long").alias("c_custkey"), "text")


def pdf_font_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ascents, descents, heights and widths of fonts that describe themselves: a part each."""
    p = _spread(_table(spark, sf_dir, "part").select("p_partkey", "p_size"))
    font = b"/Type /Font /Subtype /TrueType /BaseFont /Own /FirstChar 65 /Widths [%d %d] /FontDescriptor << /Ascent %d /Descent -%d /FontBBox [0 -%d 1000 %d] /MissingWidth %d >>"
    got = extract.fonts(_files(p, lambda n: simple_pdf([b" "], font=font % (n, 2 * n, 10 * n, n, n, 20 * n, 3 * n))))
    widths = [F.element_at("widths", c).alias(name) for c, name in ((65, "width_a"), (66, "width_b"))]
    return _doubles(got.select(F.col("doc_id").cast("long").alias("p_partkey"), "ascent", "descent", "height", "default_width", *widths))


def pdf_unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that aren't PDF files: each is a row with its error."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    return extract.extract_text(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "error_class", "text")


def pdf_roundtrip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline: documents to PDF files to text."""
    got = extract.extract_text(as_pdfs(_table(spark, sf_dir, "documents")))
    return got.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def pdf_page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = extract.documents_meta(as_pdfs(_table(spark, sf_dir, "documents")))
    return got.select(F.col("doc_id").cast("long").alias("doc_id"), "n_pages", "xref_kind", "recovered")


def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page tree's rows: number, box and matrix of every page."""
    got = extract.pages(as_pdfs(_table(spark, sf_dir, "documents")))
    return _doubles(got.select(F.col("doc_id").cast("long").alias("doc_id"), "page_no", F.element_at("media_box", 3).alias("width"), "rotate"))


def pdf_content_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each content operator runs, by document."""
    got = extract.content_ops(as_pdfs(_table(spark, sf_dir, "documents")))
    return got.groupBy(F.col("doc_id").cast("long").alias("doc_id"), "op").agg(F.count(F.lit(1)).alias("n"))


def pdf_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = extract.fonts(as_pdfs(_table(spark, sf_dir, "documents")))
    keys = [F.col("doc_id").cast("long").alias("doc_id"), "base_font", "subtype", "encoding", "unicode_source"]
    return got.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pages"), F.max(F.col("default_width").cast("double")).alias("default_width"))


def pdf_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positioned chunks of all documents: how many, and the first one's corners."""
    got = extract.chunks(as_pdfs(_table(spark, sf_dir, "documents")))
    got = _doubles(got).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    return got.agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("string_len").alias("n_chars"), F.min("x0").alias("x0"), F.max("string_len").cast("long").alias("longest"))


def pdf_relational_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relational path: parsed chunks to lines, boxes and order by DataFrame plans."""
    chunks = extract.chunks(as_pdfs(_table(spark, sf_dir, "documents")))
    text = layout.document_text(layout.layer_text(layout.lines(chunks)))
    return text.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


_EXPECTED = "string_agg(CASE WHEN line <> '' THEN line || chr(10) ELSE '' END, '' ORDER BY i)"
_SPLIT = """SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
       generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents"""


def objects_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of definitions of one object, the first in order counts."""
    e = _table(spark, sf_dir, "events").select(F.col("user_id").alias("obj_id"), "ts", "event_id")
    return relational.first_wins(e, ["obj_id"], ["ts", "event_id"]).select("obj_id", "event_id")


def recovery_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines as objects of a file whose cross references can't be found: they
    are scanned for, and of those with one number the earliest counts."""
    li = _spread(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), "l_orderkey")
    rows = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("q"))))
    rows = li.groupBy("l_orderkey").agg(rows.alias("r")).select("l_orderkey", F.transform("r", lambda r: r["l_linenumber"]).alias("n"), F.transform("r", lambda r: r["q"]).alias("q"))

    def make(numbers: list[int], quantities: list[int]) -> bytes:
        out = b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n<< /Q %d >>\nendobj\n" % x for x in zip(numbers, quantities))
        out += b"100 0 obj\n<< /Type /Pages /Kids [] >>\nendobj\n101 0 obj\n<< /Type /Catalog /Pages 100 0 R >>\nendobj\n"
        return out + b"xref\n0 1\n0000000000 65535 f \ntrailer\n<< /Root 101 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(out) + 3)

    got = extract.objects(_files(rows, make)).filter("obj_id < 100")
    q = F.decode(F.element_at("dict", "Q")["raw"], "UTF-8").cast("int")
    return got.groupBy(F.col("doc_id").cast("long").alias("l_orderkey")).agg(F.count(F.lit(1)).alias("n_objects"), F.max("obj_id").alias("last_id"), F.sum(q).alias("quantity"), F.max("source").alias("source"))


def hex_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hex strings with blanks in them."""
    return _mapped(_table(spark, sf_dir, "documents"), lambda raw: syntax.hex_string(b"<" + raw.hex("\n", 7).encode() + b" >"))


def ascii_hex_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(_table(spark, sf_dir, "documents"), lambda raw: filters.ascii_hex(raw.hex("\t", 9).encode() + b">garbage"))


def flate_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    import zlib

    return _mapped(_table(spark, sf_dir, "documents"), lambda raw: filters.flate(zlib.compress(raw)))


def lzw_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(_table(spark, sf_dir, "documents"), lambda raw: filters.lzw(filters.lzw_encode(raw)))


def ascii85_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    import base64

    return _mapped(_table(spark, sf_dir, "documents"), lambda raw: filters.ascii85(base64.a85encode(raw + b" " * (-len(raw) % 4)) + b"~>"))


def predictor_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PNG rows with the "up" tag, 16 bytes each."""
    params = {b"/Predictor": (4, b"12"), b"/Columns": (4, b"16")}
    return _mapped(_table(spark, sf_dir, "documents"), lambda raw: filters.predict(filters.up_rows(raw + b" " * (-len(raw) % 16), 16), params))


def rc4_decrypt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encrypted by the writer's cipher, which shares no code with the engine's."""
    return _mapped(_table(spark, sf_dir, "documents"), lambda raw: rc4(b"key", rc4_encrypt(b"key", raw)))


def aes_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encrypted by Spark's native function, decrypted by the engine's."""
    key, iv = b"0123456789abcdef", b"fedcba9876543210"
    d = _table(spark, sf_dir, "documents").select("doc_id", F.aes_encrypt(F.coalesce("text", F.lit("")), F.lit(key), F.lit("CBC"), F.lit("PKCS"), F.lit(iv)).alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([aes_cbc(key, r).decode() for r in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return d.mapInArrow(run, "doc_id long, text string")


def utf8_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(_table(spark, sf_dir, "documents"), syntax.code_points, "n", "long")


def _tokens(raw: bytes) -> list[bytes]:
    out, at = [], syntax.skip(raw, 0, strict=False)
    while at < len(raw):
        word, at = syntax.token(raw, at)
        out.append(word)
        at = syntax.skip(raw, at, strict=False)
    return out


def tokenize_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the texts' lines as if they were content streams."""
    lines = _table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "%", ""), "\n")).alias("text"))
    return _mapped(lines, lambda raw: len(_tokens(raw)), "n", "long").groupBy("doc_id").agg(F.sum("n").alias("n_tokens"))


def dict_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by brand as dictionaries with repeated keys: the first value of a key counts."""
    p = _table(spark, sf_dir, "part")
    entry = F.concat(F.lit("/Size"), F.col("p_size").cast("string"), F.lit(" "), F.col("p_partkey").cast("string"))
    rows = F.sort_array(F.collect_list(F.struct("p_partkey", entry.alias("e"))))
    raw = F.concat(F.lit("<< "), F.array_join(F.transform(rows, lambda r: r["e"]), " "), F.lit(" >>")).cast("binary")
    return relational.dictionary_entries(p.groupBy("p_brand").agg(raw.alias("raw")), "p_brand", "raw").select("p_brand", "key", F.col("value").cast("long").alias("partkey"))


OPENINGS = ["", "[", "(", "<<", "<", "/", "12 0 R ", "12 0 "]


def _kind(raw: bytes) -> int | None:
    try:
        return syntax.kind_at(raw, 0)[0]
    except syntax.Malformed:
        return None


def object_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of the object that each line of the documents would start, behind an opening
    that depends on the document; null for too little."""
    lines = _table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "%", ""), "\n")).alias("text"))
    opens = F.element_at(F.array(*map(F.lit, OPENINGS)), (F.col("doc_id") % len(OPENINGS) + 1).cast("int"))
    lines = lines.withColumn("text", F.concat(opens, "text"))
    return _mapped(lines, _kind, "kind", "int").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def width_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How wide part names are in Helvetica, from the chunks of files that show them."""
    files = _files(_spread(_table(spark, sf_dir, "part").select("p_partkey", "p_name")), lambda name: simple_pdf([b"BT /F1 1000 Tf %s Tj ET " % escaped(name.encode())]))
    got = extract.chunks(files)
    return got.select(F.col("doc_id").cast("long").alias("p_partkey"), F.round(F.col("x1") - F.col("x0")).cast("double").alias("width"))


def diff_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fonts whose differences are the events of a user: an event with an id that 5 divides
    sets the code, others name a character and go on by one. Shows all codes that are named."""
    e = _spread(_table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id").groupBy("user_id").agg(F.sort_array(F.collect_list("event_id")).alias("ids"))

    def make(ids: list[int]) -> bytes:
        items, code, named = [], None, set()
        for i in ids:
            if i % 5 == 0:
                code = i % 200 + 1
                items.append(b"%d" % code)
            elif code is not None:
                items.append(b"/uni%04X" % (0x4E00 + i % 9973))
                named.add(code)
                code += 1
            else:
                items.append(b"/lost")
        font = b"/Type /Font /Subtype /Type1 /BaseFont /Any /Encoding << /Differences [%s] >> /FirstChar 0 /Widths [%s]" % (b" ".join(items), b"500 " * 256)
        return simple_pdf([b"BT /F1 10 Tf <%s> Tj ET " % bytes(sorted(c for c in named if c < 256)).hex().encode()], font=font)

    got = extract.chunks(_files(e, make))
    return got.filter("text <> ''").select(F.col("doc_id").cast("long").alias("user_id"), "text")


def cmap_bfrange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character maps with a range each: codes from a nation's key to characters from A on."""
    n = _table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_nationkey").alias("first"), F.col("n_regionkey").alias("region"))

    def make(first: int, region: int) -> bytes:
        w = PdfWriter()
        tree = w.reserve()
        cmap = w.stream(b"1 beginbfrange\n<%04x> <%04x> <%04x>\nendbfrange\nend\n" % (first, first + region * 60, 65 + first))
        inner = w.add(b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Any /DW 500 >>")
        face = w.add(b"<< /Type /Font /Subtype /Type0 /BaseFont /Any /Encoding /Identity-H /DescendantFonts [%d 0 R] /ToUnicode %d 0 R >>" % (inner, cmap))
        codes = range(first, first + min(region * 60, 255 - 65 - first) + 1)  # the last byte of the text ends the range
        body = w.stream(b"BT /F1 10 Tf <%s> Tj ET " % b"".join(b"%04x" % c for c in codes))
        page = w.add(b"<< /Type /Page /Parent %d 0 R /MediaBox [0 0 612 792] /Resources << /Font << /F1 %d 0 R >> >> /Contents %d 0 R >>" % (tree, face, body))
        w.add(b"<< /Type /Pages /Count 1 /Kids [%d 0 R] >>" % page, tree)
        return w.finish(w.add(b"<< /Type /Catalog /Pages %d 0 R >>" % tree))

    return extract.chunks(_files(n, make)).select(F.col("doc_id").cast("int").alias("n_nationkey"), "text", "string_len")


_LINES = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _shown_lines(spark: SparkSession, sf_dir: str, shown: Callable[..., bytes]) -> DataFrame:
    """Order lines with the corners of the chunk that ``shown`` (a content stream of quantity,
    line number, tax and discount in percent) makes: a file an order, a page a line."""
    li = _spread(_table(spark, sf_dir, "lineitem").select(*_LINES, "l_quantity", "l_tax", "l_discount"), "l_orderkey")
    own = F.struct(*_LINES[1:], F.col("l_quantity").cast("int").alias("q"), F.round(F.col("l_tax") * 100).cast("int").alias("t"), F.round(F.col("l_discount") * 100).cast("int").alias("d"))
    rows = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(own)).alias("r"))
    flat = [F.col(f"r.{f}").alias(f) for f in ("q", "l_linenumber", "t", "d")]  # arrays of the fields

    def make(*parts: list[int]) -> bytes:
        font = b"/Type /Font /Subtype /TrueType /BaseFont /Any"  # without widths and descent
        return simple_pdf([shown(*p) for p in zip(*parts)], font=font)

    got = extract.chunks(_files(rows.select("l_orderkey", *flat), make))
    lines = rows.select("l_orderkey", F.posexplode("r").alias("page_no", "r")).select(F.col("l_orderkey").cast("string").alias("doc_id"), "l_orderkey", "page_no", *[f"r.{c}" for c in _LINES[1:]])
    return _doubles(got.join(lines, ["doc_id", "page_no"]).select(*_LINES, "x0", "y0", "x1", "y1"))


def matrix_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text matrices within concatenated ones: the corners of a string of no width."""
    body = b"%d %d %d %g %d %d cm BT /F1 1 Tf %d %d %d %g %d %d Tm (x) Tj ET "
    return _shown_lines(spark, sf_dir, lambda q, n, t, d: body % (q, n, 2 * n, q * 0.25, t, d, q, n, 2 * n, q * 0.5, t, d))


def apply_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points moved by Td within a text matrix."""
    return _shown_lines(spark, sf_dir, lambda q, n, t, d: b"BT /F1 1 Tf %d %d %d %g %d %d Tm %d %d Td (x) Tj ET " % (q, n, 2 * n, q * 0.5, t, d, q, n))


def inherit_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page trees that inherit boxes and turns: a file a region, a node a nation, a page a
    customer. Pages come in order of nations and customers."""
    c, n, r = (_table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    own = F.sort_array(F.collect_list(F.struct("c_custkey", F.when(F.col("c_acctbal") < 0, F.col("c_custkey") + 1000).alias("box"))))
    nations = n.join(c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(own.alias("own")), "n_nationkey")
    nations = nations.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.sort_array(F.collect_list(F.struct("n_nationkey", F.transform("own", lambda x: F.coalesce(x["box"], F.lit(0).cast("long"))).alias("boxes")))).alias("n"))
    rows = r.join(nations, "r_regionkey").select("r_regionkey", F.transform("n", lambda x: x["n_nationkey"]).alias("keys"), F.transform("n", lambda x: x["boxes"]).alias("boxes"), (F.col("r_regionkey") * 100 + 100).alias("width"))

    def make(keys: list[int], boxes: list[list[int]], width: int) -> bytes:
        w = PdfWriter()
        tree, kids = w.reserve(), []
        for key, own in zip(keys, boxes):
            node = w.reserve()
            pages = [w.add(b"<< /Type /Page /Parent %d 0 R%s >>" % (node, b" /MediaBox [0 0 %d 9]" % b if b else b"")) for b in own]
            extra = b" /MediaBox [0 0 %d 9] /Rotate 90" % (key + 1) if key % 2 == 0 else b""
            kids.append(w.add(b"<< /Type /Pages /Parent %d 0 R /Kids [%s]%s >>" % (tree, b" ".join(b"%d 0 R" % p for p in pages), extra), node))
        w.add(b"<< /Type /Pages /MediaBox [0 0 %d 9] /Kids [%s] >>" % (width, b" ".join(b"%d 0 R" % k for k in kids)), tree)
        return w.finish(w.add(b"<< /Type /Catalog /Pages %d 0 R >>" % tree))

    got = extract.pages(_files(_spread(rows), make))
    out = got.select(F.col("doc_id").cast("int").alias("r_regionkey"), "page_no", F.element_at("media_box", 3).alias("width"), "rotate", F.element_at("ctm", 2).alias("b"), F.element_at("ctm", 6).alias("f"))
    return _doubles(out).withColumns({c: F.col(c) + 0.0 for c in "bf"})  # no negative zeros


def inherit_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a relation over all nodes: customers from nations from regions."""
    c, n, r = (_table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    nodes = (
        r.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), (F.col("r_regionkey") * 100).cast("double").alias("box"))
        .union(n.select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey").cast("double"))))
        .union(c.select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), F.when(F.col("c_acctbal") < 0, F.col("c_acctbal"))))
    )
    return relational.inherited(nodes, "id", "parent", "box")


def layout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubles(_lines(spark, sf_dir)).select("doc_id", "page_no", "line_no", "x0", "y0", "x1", "y1", "string_len")


def layout_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("doc_id", "page_no", "line_no", "text")


def zero_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of chunks where every seventh has no width."""
    c = as_chunks(_table(spark, sf_dir, "documents"))
    c = c.withColumn("x1", F.when(F.col("seq") % 7 == 3, F.col("x0")).otherwise(F.col("x1")))
    got = layout.flat_groups(c, "seq")
    return _doubles(got.groupBy("doc_id", "page_no", "group_no").agg(F.count(F.lit(1)).alias("n"), F.min("x0").alias("x0"), F.max("x1").alias("x1")))


def neighbour_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.neighbour_pairs(_lines(spark, sf_dir)).select("doc_id", "page_no", "a", "b")


def box_distance_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pair of lines of each page that leaves the least empty area in its union."""
    return _doubles(layout.closest(_lines(spark, sf_dir).withColumnRenamed("line_no", "box_no"))).select("doc_id", "page_no", "a", "b", "waste")


def between_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs of a page's boxes have another box between them (no SQL)."""
    got = layout.between_counts(layout.boxes(_lines(spark, sf_dir)))
    return got.groupBy("doc_id", "page_no").agg(F.sum("n").alias("n_pairs"))


def reading_order_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubles(layout.order_keys(_lines(spark, sf_dir))).select("doc_id", "page_no", "line_no", "order_key")


def page_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = _lines(spark, sf_dir).groupBy(*layout.LAYER).agg(layout._ordered("text", "line_no").alias("text"))
    return layout.document_text(pieces)


def layout_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of neighbouring lines (no SQL: tested against brute force)."""
    return layout.box_numbers(_lines(spark, sf_dir)).select("doc_id", "page_no", "line_no", "box_no")


def plane_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, boxes, reading order and text of all documents (no SQL)."""
    return layout.document_text(layout.layer_text(_lines(spark, sf_dir)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        pdf_roundtrip_text, pdf_page_count, pdf_pages, pdf_content_ops, pdf_fonts, pdf_chunks, pdf_relational_text, *map(_round_trip, ROUND_TRIPS), pdf_aes, pdf_files, pdf_charsets, pdf_vertical, pdf_font_metrics, pdf_unreadable,
        objects_first_wins, recovery_scan, hex_decode, ascii_hex_decode, flate_decode, lzw_decode, ascii85_decode, predictor_decode, rc4_decrypt, aes_roundtrip, utf8_length,
        tokenize_content, dict_first_wins, object_kinds, width_lookup, diff_encoding, cmap_bfrange, matrix_product, apply_point, inherit_box, inherit_values, layout_lines, layout_words, zero_groups, neighbour_pairs,
        box_distance_top1, between_exists, reading_order_key, page_concat, layout_boxes, plane_full,
    )
}

_SAME = "SELECT doc_id, coalesce(text, '') AS text FROM documents"
_HELVETICA = ", ".join(f"({c}, {w})" for c, w in sorted(encodings.core_font("Helvetica")[0].items()) if c < 256)
_M = """CAST(l_quantity AS INTEGER) AS a, l_linenumber AS b, l_linenumber * 2 AS c, round(l_tax * 100) AS e, round(l_discount * 100) AS f"""
_PAIRS = """pairs AS (
  SELECT p.doc_id, p.page_no, p.line_no AS a, q.line_no AS b,
         (greatest(p.x1, q.x1) - least(p.x0, q.x0)) * (greatest(p.y1, q.y1) - least(p.y0, q.y0)) - (p.x1 - p.x0) * (p.y1 - p.y0) - (q.x1 - q.x0) * (q.y1 - q.y0) AS waste
  FROM lines p JOIN lines q ON p.doc_id = q.doc_id AND p.page_no = q.page_no AND p.line_no < q.line_no)"""

ORACLE_SQL: dict[str, str] = {
    "pdf_roundtrip_text": f"SELECT doc_id, {_EXPECTED} AS text FROM ({_SPLIT}) GROUP BY doc_id",
    "pdf_relational_text": f"SELECT doc_id, text FROM (SELECT doc_id, {_EXPECTED} AS text FROM ({_SPLIT}) GROUP BY doc_id) WHERE text <> ''",
    "pdf_page_count": f"SELECT doc_id, CAST(ceil(count(*) / {LINES_A_PAGE}.0) AS INTEGER) AS n_pages, 'table' AS xref_kind, false AS recovered FROM ({_SPLIT}) GROUP BY doc_id",
    "pdf_pages": f"""SELECT doc_id, CAST(unnest(range(CAST(ceil(n / {LINES_A_PAGE}.0) AS BIGINT))) AS INTEGER) AS page_no, 612.0::DOUBLE AS width, 0 AS rotate
                     FROM (SELECT doc_id, count(*) AS n FROM ({_SPLIT}) GROUP BY doc_id)""",
    "pdf_content_ops": f"""
        WITH l AS (SELECT doc_id, count(*) AS n, sum((line <> '')::INT) AS shown FROM ({_SPLIT}) GROUP BY doc_id), p AS (SELECT *, ceil(n / {LINES_A_PAGE}.0) AS pages FROM l)
        SELECT doc_id, 'BT' AS op, CAST(pages AS BIGINT) AS n FROM p UNION ALL SELECT doc_id, 'ET', CAST(pages AS BIGINT) FROM p UNION ALL SELECT doc_id, 'Tf', CAST(pages AS BIGINT) FROM p
        UNION ALL SELECT doc_id, 'Td', CAST(pages + n AS BIGINT) FROM p UNION ALL SELECT doc_id, 'Tj', CAST(shown AS BIGINT) FROM p WHERE shown > 0""",
    "pdf_fonts": f"""SELECT doc_id, 'Any' AS base_font, 'Type0' AS subtype, '/Identity-H' AS encoding, 'ToUnicode' AS unicode_source,
                     CAST(ceil(count(*) / {LINES_A_PAGE}.0) AS BIGINT) AS n_pages, 1000.0::DOUBLE * 0.6 AS default_width FROM ({_SPLIT}) GROUP BY doc_id""",
    "pdf_chunks": f"""SELECT doc_id, count(*) AS n_chunks, CAST(sum(length(line)) AS BIGINT) AS n_chars, 36.0::DOUBLE AS x0, max(length(line)) AS longest
                      FROM ({_SPLIT}) WHERE line <> '' GROUP BY doc_id""",
    "objects_first_wins": "SELECT obj_id, event_id FROM (SELECT user_id AS obj_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1",
    **{k: f"SELECT doc_id, {_EXPECTED} AS text FROM ({_SPLIT}) GROUP BY doc_id" for k in [*ROUND_TRIPS, "pdf_aes"]},
    "pdf_files": "SELECT n_nationkey, n_name || chr(10) AS text FROM nation",
    "pdf_charsets": "SELECT n_nationkey, '日本' || n_name || chr(10) AS text FROM nation",
    "pdf_vertical": "SELECT c_custkey, '' AS text FROM customer",
    "pdf_font_metrics": """SELECT p_partkey, (10 * p_size)::DOUBLE AS ascent, (-p_size)::DOUBLE AS descent, (21 * p_size)::DOUBLE AS height, (3 * p_size)::DOUBLE AS default_width,
                           p_size::DOUBLE AS width_a, (2 * p_size)::DOUBLE AS width_b FROM part""",
    "pdf_unreadable": "SELECT doc_id, 'Malformed' AS error_class, NULL::VARCHAR AS text FROM documents",
    "recovery_scan": """SELECT l_orderkey, count(*) AS n_objects, max(l_linenumber) AS last_id, CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS quantity, 'scan' AS source
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, CAST(l_quantity AS INTEGER)) AS r FROM lineitem) WHERE r = 1 GROUP BY l_orderkey""",
    **{k: _SAME for k in ("hex_decode", "ascii_hex_decode", "flate_decode", "lzw_decode", "rc4_decrypt", "aes_roundtrip")},
    "ascii85_decode": "SELECT doc_id, t || repeat(' ', (4 - octet_length(encode(t)) % 4) % 4) AS text FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
    "predictor_decode": "SELECT doc_id, t || repeat(' ', (16 - octet_length(encode(t)) % 16) % 16) AS text FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
    "utf8_length": "SELECT doc_id, length(coalesce(text, '')) AS n FROM documents",
    "tokenize_content": rf"""SELECT doc_id, CAST(sum(len(regexp_extract_all(replace(line, '%', ''), '[^ \r\n\t][^ \r\n\t/\[(<]*'))) AS BIGINT) AS n_tokens FROM ({_SPLIT}) GROUP BY doc_id""",
    "dict_first_wins": "SELECT p_brand, '/Size' || p_size AS key, min(p_partkey) AS partkey FROM part GROUP BY p_brand, p_size",
    "object_kinds": rf"""SELECT CAST(CASE WHEN length(t) < 2 THEN NULL WHEN t LIKE '[%' THEN 2 WHEN t LIKE '(%' THEN 3 WHEN t LIKE '<<%' THEN 1 WHEN t LIKE '<%' THEN 3 WHEN t LIKE '/%' THEN 6
                                    WHEN regexp_matches(t, '^\d+[\n\t\r ]+\d+[\n\t\r ]+R') THEN 5 ELSE 4 END AS INTEGER) AS kind, count(*) AS n
                        FROM (SELECT ltrim({OPENINGS!r}[doc_id % {len(OPENINGS)} + 1] || replace(line, '%', ''), chr(13) || chr(10) || chr(9) || ' ') AS t FROM ({_SPLIT})) GROUP BY kind""",
    "width_lookup": f"""WITH w(code, width) AS (VALUES {_HELVETICA})
        SELECT p_partkey, coalesce(sum(width), 0)::DOUBLE AS width FROM (SELECT p_partkey, unnest(string_split(p_name, '')) AS c FROM part) LEFT JOIN w ON code = ord(c) GROUP BY p_partkey""",
    "diff_encoding": """
        WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 5 = 0 THEN event_id % 200 + 1 END AS code FROM events),
        g AS (SELECT *, count(code) OVER (PARTITION BY user_id ORDER BY event_id) AS grp FROM e),
        r AS (SELECT user_id, event_id, code, max(code) OVER (PARTITION BY user_id, grp) + row_number() OVER (PARTITION BY user_id, grp ORDER BY event_id) - 2 AS running FROM g WHERE grp > 0),
        l AS (SELECT * FROM r WHERE code IS NULL AND running < 256 QUALIFY row_number() OVER (PARTITION BY user_id, running ORDER BY event_id DESC) = 1)
        SELECT user_id, string_agg(chr(CAST(19968 + event_id % 9973 AS INTEGER)), '' ORDER BY running) AS text FROM l GROUP BY user_id""",
    "cmap_bfrange": """SELECT n_nationkey, string_agg(chr(CAST(65 + n_nationkey + i AS INTEGER)), '' ORDER BY i) AS text, CAST(count(*) AS INTEGER) AS string_len
        FROM (SELECT n_nationkey, unnest(range(least(n_regionkey * 60, 255 - (65 + n_nationkey)) + 1)) AS i FROM nation) GROUP BY n_nationkey""",
    "matrix_product": f"""
        WITH m AS (SELECT *, {_M} FROM lineitem), n AS (SELECT *, a * 0.5 AS d1, a * 0.25 AS d2 FROM m),
        p AS (SELECT *, a * c + c * d1 AS pc, b * c + d2 * d1 AS pd, a * e + c * f + e AS pe, b * e + d2 * f + f AS pf FROM n)
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, pe::DOUBLE AS x0, pf::DOUBLE AS y0, (pe + pc)::DOUBLE AS x1, (pf + pd)::DOUBLE AS y1 FROM p""",
    "apply_point": f"""WITH m AS (SELECT *, {_M} FROM lineitem), p AS (SELECT *, a * a + c * b + e AS x, b * a + a * 0.5 * b + f AS y FROM m)
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, x::DOUBLE AS x0, y::DOUBLE AS y0, (x + c)::DOUBLE AS x1, (y + a * 0.5)::DOUBLE AS y1 FROM p""",
    "inherit_box": """
        SELECT n_regionkey AS r_regionkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey, c_custkey) - 1 AS INTEGER) AS page_no,
               CAST(CASE WHEN c_acctbal < 0 THEN c_custkey + 1000 WHEN n_nationkey % 2 = 0 THEN n_nationkey + 1 ELSE n_regionkey * 100 + 100 END AS DOUBLE) AS width,
               CASE WHEN n_nationkey % 2 = 0 THEN 90 ELSE 0 END AS rotate, CASE WHEN n_nationkey % 2 = 0 THEN -1.0 ELSE 0.0 END::DOUBLE AS b,
               CAST(CASE WHEN n_nationkey % 2 <> 0 THEN 0 WHEN c_acctbal < 0 THEN c_custkey + 1000 ELSE n_nationkey + 1 END AS DOUBLE) AS f
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "inherit_values": """
        WITH r AS (SELECT 'r' || r_regionkey AS id, (r_regionkey * 100)::DOUBLE AS box, r_regionkey FROM region),
        n AS (SELECT 'n' || n_nationkey AS id, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey::DOUBLE END, box) AS box, n_nationkey FROM nation JOIN r ON n_regionkey = r_regionkey),
        c AS (SELECT 'c' || c_custkey AS id, coalesce(CASE WHEN c_acctbal < 0 THEN c_acctbal END, box) AS box FROM customer JOIN n ON c_nationkey = n_nationkey)
        SELECT id, box FROM r UNION ALL SELECT id, box FROM n UNION ALL SELECT id, box FROM c""",
    "layout_lines": f"WITH {_CHUNKS} SELECT doc_id, page_no, line_no, x0, y0, x1, y1, string_len FROM lines",
    "layout_words": f"WITH {_CHUNKS} SELECT doc_id, page_no, line_no, text FROM lines",
    "zero_groups": f"""WITH {_CHUNKS}, z AS (SELECT doc_id, page_no, seq, x0, CASE WHEN seq % 7 = 3 THEN x0 ELSE x1 END AS x1 FROM chunks),
        g AS (SELECT *, sum((x1 <= x0)::INT) OVER w AS k, row_number() OVER w AS r FROM z WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY seq))
        SELECT doc_id, page_no, CAST(CASE WHEN k = 0 THEN -r ELSE k END AS INTEGER) AS group_no, count(*) AS n, min(x0) AS x0, max(x1) AS x1 FROM g GROUP BY ALL""",
    "neighbour_pairs": f"""WITH {_CHUNKS}, h AS MATERIALIZED (SELECT *, y1 - y0 AS h, CAST(floor(y0 / 64) AS INTEGER) AS band FROM lines WHERE y1 - y0 < 32),
        near AS (SELECT *, unnest([band - 1, band, band + 1]) AS other FROM h)
        SELECT p.doc_id, p.page_no, p.line_no AS a, q.line_no AS b FROM near p JOIN h q ON p.doc_id = q.doc_id AND p.page_no = q.page_no AND p.other = q.band AND p.line_no < q.line_no
        WHERE abs(p.h - q.h) < greatest(p.h, q.h) * 0.5 AND p.x1 > q.x0 AND p.x0 < q.x1 AND p.y0 < q.y1 + greatest(p.h, q.h) * 0.5 AND p.y1 > q.y0 - greatest(p.h, q.h) * 0.5
          AND (abs(p.x0 - q.x0) < greatest(p.h, q.h) * 0.5 OR abs(p.x1 - q.x1) < greatest(p.h, q.h) * 0.5)""",
    "box_distance_top1": f"""WITH {_CHUNKS}, {_PAIRS}, m AS (SELECT doc_id, page_no, min({{'waste': waste, 'a': a, 'b': b}}) AS m FROM pairs GROUP BY doc_id, page_no)
        SELECT doc_id, page_no, m.a AS a, m.b AS b, m.waste AS waste FROM m""",
    "reading_order_key": f"WITH {_CHUNKS} SELECT doc_id, page_no, line_no, 0.5::DOUBLE * x0 - 1.5::DOUBLE * (y0 + y1) AS order_key FROM lines",
    "page_concat": f"WITH {_CHUNKS} SELECT doc_id, string_agg(text, '' ORDER BY page_no, line_no) AS text FROM lines GROUP BY doc_id",
}
