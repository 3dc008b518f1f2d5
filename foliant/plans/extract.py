"""Extraction plans: one pass over document bytes, each stage a DataFrame.

``parse`` reads every document once, in Arrow batches, and returns one row each with
the stages asked for as nested columns; ``objects``, ``pages``, ``fonts``, ``content_ops``
and ``chunks`` unnest them. ``extract_text`` is the fused path, without a shuffle. A
document that can't be read is a row with its error.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import glyphs
from ..functions.syntax import DICTIONARY, Malformed, dictionary
from ..operators.document import Document
from ..operators.interpreter import Chunk, Page, Pages
from ..operators.layout import render
from ..session import reach_workers

#: What a damaged document can raise while it is read.
ERRORS = (Malformed, KeyError, IndexError, ValueError, OverflowError, RecursionError, LookupError, MemoryError)

_VALUE = "struct<raw:binary,type:tinyint>"
_NESTED = {
    "objects": f"array<struct<obj_id:int,offset:bigint,source:string,type:tinyint,raw:binary,dict:map<string,{_VALUE}>>>",
    "pages": "array<struct<page_no:int,page_id:int,media_box:array<float>,rotate:int,ctm:array<float>>>",
    "fonts": "array<struct<page_no:int,font_name:string,base_font:string,subtype:string,encoding:string,unicode_source:string,descent:float,ascent:float,height:float,default_width:float,widths:map<int,float>,scale_x:float,scale_y:float>>",
    "content_ops": "array<struct<page_no:int,part:tinyint,seq:int,op:string,operands:array<struct<type:tinyint,raw:binary>>>>",
    "chunks": "array<struct<page_no:int,part:tinyint,layer_no:int,seq:int,font_name:string,x0:float,y0:float,x1:float,y1:float,text:string,text_bytes:binary,string_len:int>>",
    "page_text": "array<struct<page_no:int,part:tinyint,layer_no:int,text:string,text_bytes:binary>>",
}
_META = (
    "doc_id string, xref_kind string, is_damaged boolean, recovered boolean, encrypt_algorithm string, n_objects int, n_pages int, n_annot_errors int, "
    "n_page_errors int, error_class string, error_message string"
)
_V = pa.struct([("raw", pa.binary()), ("type", pa.int8())])
_ARROW = {
    "objects": pa.list_(pa.struct([("obj_id", pa.int32()), ("offset", pa.int64()), ("source", pa.string()), ("type", pa.int8()), ("raw", pa.binary()), ("dict", pa.map_(pa.string(), _V))])),
    "pages": pa.list_(pa.struct([("page_no", pa.int32()), ("page_id", pa.int32()), ("media_box", pa.list_(pa.float32())), ("rotate", pa.int32()), ("ctm", pa.list_(pa.float32()))])),
    "fonts": pa.list_(pa.struct([("page_no", pa.int32()), ("font_name", pa.string()), ("base_font", pa.string()), ("subtype", pa.string()), ("encoding", pa.string()), ("unicode_source", pa.string()), ("descent", pa.float32()), ("ascent", pa.float32()), ("height", pa.float32()), ("default_width", pa.float32()), ("widths", pa.map_(pa.int32(), pa.float32())), ("scale_x", pa.float32()), ("scale_y", pa.float32())])),
    "content_ops": pa.list_(pa.struct([("page_no", pa.int32()), ("part", pa.int8()), ("seq", pa.int32()), ("op", pa.string()), ("operands", pa.list_(pa.struct([("type", pa.int8()), ("raw", pa.binary())])))])),
    "chunks": pa.list_(pa.struct([("page_no", pa.int32()), ("part", pa.int8()), ("layer_no", pa.int32()), ("seq", pa.int32()), ("font_name", pa.string()), ("x0", pa.float32()), ("y0", pa.float32()), ("x1", pa.float32()), ("y1", pa.float32()), ("text", pa.string()), ("text_bytes", pa.binary()), ("string_len", pa.int32())])),
    "page_text": pa.list_(pa.struct([("page_no", pa.int32()), ("part", pa.int8()), ("layer_no", pa.int32()), ("text", pa.string()), ("text_bytes", pa.binary())])),
}
_META_ARROW = [pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
_META_NAMES = [f.split()[0] for f in _META.split(", ")]


def _text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def _named(raw: bytes) -> str:
    return raw.decode("latin-1").removeprefix("/")


def _objects(doc: Document) -> list[dict]:
    rows = []
    for number in sorted({*doc.offsets, *doc.packed}):
        own = number in doc.offsets
        try:
            kind, raw = doc.get(number)
            entries = [(_named(k), {"raw": v, "type": t}) for k, (t, v) in dictionary(raw).items()] if kind == DICTIONARY else None
        except ERRORS:
            continue
        source = ("scan" if doc.recovered else "xref") if own else "objstm"
        rows.append({"obj_id": number, "offset": doc.offsets.get(number), "source": source, "type": kind, "raw": raw, "dict": entries})
    return rows


def _page_row(i: int, p: Page) -> dict:
    return {"page_no": i, "page_id": p.number, "media_box": list(p.box), "rotate": p.rotate, "ctm": list(p.matrix)}


def _font_rows(i: int, page: Page) -> list[dict]:
    out = []
    for name, f in page.scope.fonts.fonts.items():
        encoding = f.props.get(b"/Encoding")
        source = next((k for k in ("ToUnicode", "Encoding") if b"/" + k.encode() in f.props), None)
        out.append(
            {
                "page_no": i, "font_name": _named(name), "base_font": f.base, "subtype": _named(f.subtype), "encoding": encoding and _text(encoding[1]), "unicode_source": source,
                "descent": f.descent, "ascent": f.ascent, "height": f.height, "default_width": f.default_width, "widths": [(int(c), float(w)) for c, w in f.widths.items() if c < 1 << 31],
                "scale_x": f.scale[0], "scale_y": f.scale[1],
            }
        )
    return out


def _chunk_rows(i: int, part: int, layers: list[list[Chunk]]) -> list[dict]:
    return [
        {"page_no": i, "part": part, "layer_no": n, "seq": s, "font_name": _named(c.font), "x0": c.x0, "y0": c.y0, "x1": c.x1, "y1": c.y1, "text": _text(c.text), "text_bytes": c.text, "string_len": c.length}
        for n, layer in enumerate(layers) for s, c in enumerate(layer)
    ]


def read_document(buf: bytes, want: tuple[str, ...], compat: bool = True, partial: bool = False) -> dict:
    """One document's stages. Any error of a page's content fails the document, unless
    ``partial``; errors of annotations are only counted."""
    doc = Document(buf, compat)
    out: dict = {
        "xref_kind": "table" if doc.classic else "stream", "is_damaged": doc.damaged, "recovered": doc.recovered, "encrypt_algorithm": doc.encryption,
        "n_objects": len({*doc.offsets, *doc.packed}), "n_annot_errors": 0, "n_page_errors": 0,
    }
    tree = Pages(doc)
    out["n_pages"] = len(tree.pages)
    rows: dict[str, list] = {k: [] for k in want}
    if "objects" in want:
        rows["objects"] = _objects(doc)
    interpret = bool({"content_ops", "chunks", "page_text"} & {*want})
    for i, page in enumerate(tree.pages):
        if "pages" in want:
            rows["pages"].append(_page_row(i, page))
        if "fonts" in want:
            rows["fonts"] += _font_rows(i, page)
        seen: set[int] = set()
        for part in (0, 1) if interpret else ():
            log: list | None = [] if "content_ops" in want else None
            try:
                ids = tree.annotations(page) if part else tree.contents(page)
                try:
                    layers = tree.layers(page, ids, seen, log)
                    shown = [render(layer) for layer in layers] if "page_text" in want else []
                except ERRORS:
                    if not part:
                        raise
                    out["n_annot_errors"] += 1
                    continue
            except ERRORS:
                if not partial:
                    raise
                out["n_page_errors"] += 1
                continue
            if "chunks" in want:
                rows["chunks"] += _chunk_rows(i, part, layers)
            if "page_text" in want:
                rows["page_text"] += [{"page_no": i, "part": part, "layer_no": n, "text": _text(t), "text_bytes": t} for n, t in enumerate(shown)]
            if log is not None:
                rows["content_ops"] += [{"page_no": i, "part": part, "seq": s, "op": _text(op), "operands": [{"type": k, "raw": r} for k, r in st]} for s, (op, st) in enumerate(log)]
    return out | rows


def parse(files: DataFrame, want: tuple[str, ...] = ("pages", "chunks"), *, compat: bool = True, partial: bool = False, glyph_names: dict[str, str] | None = None) -> DataFrame:
    """One row a document of ``files`` (path, content): its properties, the stages in
    ``want`` as nested columns, or its error. glyph_names: a published list's names, as
    ``glyphs.read_glyph_list`` reads them, that come before those known by rule."""
    reach_workers(files.sparkSession)
    names, kinds = [*_META_NAMES, *want], [*_META_ARROW, *(_ARROW[w] for w in want)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        glyphs.use(glyph_names)
        for batch in batches:
            for lo in range(0, batch.num_rows, 16):
                rows = []
                for path, content in zip(batch.column(0).slice(lo, 16).to_pylist(), batch.column(1).slice(lo, 16)):
                    row: dict = {"doc_id": path}
                    try:
                        raw = content.as_py()
                        if raw is None:
                            raise Malformed("no content")
                        row |= read_document(raw, want, compat, partial)
                    except ERRORS as e:
                        row |= {"error_class": type(e).__name__, "error_message": str(e)[:500]}
                    rows.append(row)
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds)], names)

    schema = _META + "".join(f", {w} {_NESTED[w]}" for w in want)
    return files.select(F.col("path").cast("string"), "content").mapInArrow(run, schema)


def unnest(parsed: DataFrame, stage: str) -> DataFrame:
    """doc_id and the columns of one stage, a row each."""
    return parsed.select("doc_id", F.explode(stage).alias("r")).select("doc_id", "r.*")


def objects(files: DataFrame, **options) -> DataFrame:
    return unnest(parse(files, ("objects",), **options), "objects")


def pages(files: DataFrame, **options) -> DataFrame:
    return unnest(parse(files, ("pages",), **options), "pages")


def fonts(files: DataFrame, **options) -> DataFrame:
    return unnest(parse(files, ("fonts",), **options), "fonts")


def content_ops(files: DataFrame, **options) -> DataFrame:
    return unnest(parse(files, ("content_ops",), **options), "content_ops")


def chunks(files: DataFrame, **options) -> DataFrame:
    return unnest(parse(files, ("chunks",), **options), "chunks")


def documents_meta(files: DataFrame, **options) -> DataFrame:
    return parse(files, (), **options)


def extract_text(files: DataFrame, **options) -> DataFrame:
    """doc_id, text, text_bytes, error_class, error_message: the whole pipeline."""
    parsed = parse(files, ("page_text",), **options)
    raw = F.aggregate("page_text", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["text_bytes"]))
    text = F.array_join(F.transform("page_text", lambda x: x["text"]), "")
    return parsed.select("doc_id", text.alias("text"), raw.alias("text_bytes"), "error_class", "error_message")
