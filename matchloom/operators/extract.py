"""Structured extraction from text lines.

Documents are rows ``(doc_id, lines array<string>)``; :func:`gather_lines` builds them from a line table.
``layout='pdf'`` ignores blank lines, ``layout='docx'`` splits blocks on them.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions.anchored import openers
from ..functions.segmented import Running, running
from ..sources.scratch import stored

# Patterns.
_EMAIL = r"(?U)\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
_PHONE = r"(?U)\+\d{1,3}[\s\-]?\(?\d{1,4}\)?[\s\-]?\d{2,4}(?:[\s\-]?\d{2,4}){1,2}"
_URL = r"(?iU)\bhttps?://[^\s,;]+"
_DOMAIN = r"(?iU)\b(?:www\.)?[a-zA-Z0-9\-]+\.(?:com|net|org|io|dev|co|me|ai|app)(?:/[^\s,;]*)?"
_NAME = r"(?U)^([A-ZÁÉÍÓÚÑ][a-záéíóúñ']+(?:\s+[A-ZÁÉÍÓÚÑ][a-záéíóúñ']+){1,3})\s*$"
_DATES = r"(?iU)(\d{4})\s*[\-–—]\s*(\d{4}|present|actualidad|hoy)"
_HEADERS = {
    "work": r"EXPERIENCE|WORK\s+EXPERIENCE|EMPLOYMENT|EXPERIENCIA|EXPERIENCIA\s+LABORAL|TRABAJO",
    "education": r"EDUCATION|ACADEMIC|EDUCACION|EDUCACIÓN|FORMACION|FORMACIÓN",
    "skills": r"SKILLS|TECHNICAL\s+SKILLS|HABILIDADES|HABILIDADES\s+TECNICAS|HABILIDADES\s+TÉCNICAS|COMPETENCIAS",
    "generic": r"CONTACTO|PERFIL|RESUMEN|IDIOMAS|CERTIFICACIONES|REFERENCIAS|PUBLICACIONES|PROYECTOS|CONTACT|PROFILE|SUMMARY|LANGUAGES|CERTIFICATIONS|PROJECTS",
}
PROJECT_HEADERS = r"PROYECTOS|PROJECTS"


def _header(words: str) -> str:
    return r"(?iU)^\s*(?:" + words + r")\s*[\.\:]*\s*$"


_ANY_HEADER = _header("|".join(_HEADERS.values()))
DEFAULT_NAME, DEFAULT_EMAIL = "Unknown Candidate", "unknown@example.com"


def gather_lines(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows ``(key, lines)`` from ``(key, pos, text)``; the lines of one document are one row."""
    return lines.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("lines"))


def _nonblank(lines: Column) -> Column:
    return F.filter(lines, lambda x: ~tx.is_blank(x))


def _first(array: Column) -> Column:
    return F.get(array, F.lit(0))


def _match(line: Column, pattern: str, group: int = 0) -> Column:
    return F.when(line.rlike(pattern), F.regexp_extract(line, "(" + pattern + ")" if not group else pattern, group or 1))


def extract_basics(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """First e-mail, phone, URL and name line; a line that gave one field is not read for the later ones."""
    cells = F.transform(_nonblank(F.col("lines")), lambda raw, i: tx.let(tx.trim_space(raw), lambda x: F.struct(
        i.alias("i"), _match(x, _EMAIL).alias("email"), _match(x, _PHONE).alias("phone"), _match(x, _URL).alias("url"),
        F.when(x.rlike(_NAME), x).alias("name"))))

    def pick(c: Column) -> Column:
        email = _first(F.filter(c, lambda x: x["email"].isNotNull()))
        return tx.let(email, lambda e: tx.let(
            _first(F.filter(c, lambda x: x["phone"].isNotNull() & ~x["i"].eqNullSafe(e["i"]))), lambda p: tx.let(
                _first(F.filter(c, lambda x: x["url"].isNotNull() & ~x["i"].eqNullSafe(e["i"]) & ~x["i"].eqNullSafe(p["i"]))), lambda u: tx.let(
                    _first(F.filter(c, lambda x: x["name"].isNotNull() & ~x["i"].eqNullSafe(e["i"]) & ~x["i"].eqNullSafe(p["i"]) & ~x["i"].eqNullSafe(u["i"]))),
                    lambda n: F.struct(
                        F.coalesce(n["name"], F.lit(DEFAULT_NAME)).alias("name"), F.coalesce(e["email"], F.lit(DEFAULT_EMAIL)).alias("email"),
                        tx.trim_space(p["phone"]).alias("phone"), F.regexp_replace(u["url"], r"[.,;]+\z", "").alias("url"))))))

    return docs.withColumn("_b", tx.let(cells, pick)).select(key, "_b.*")


def network_of(url: Column) -> Column:
    low = F.lower(url)
    return (F.when(low.contains("linkedin.com"), "LinkedIn").when(low.contains("github.com") | low.contains("github.io"), "GitHub")
            .when(low.contains("twitter.com") | low.contains("x.com"), "Twitter").when(low.contains("behance.net"), "Behance")
            .when(low.contains("dribbble.com"), "Dribbble"))


def extract_profiles(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, ord, network, url)``; links differing only in case are one, the first counts."""
    urls = F.flatten(F.transform(_nonblank(F.col("lines")), lambda x: F.regexp_extract_all(tx.trim_space(x), F.lit("(" + _DOMAIN + ")"), F.lit(1))))
    found = F.filter(F.transform(urls, lambda u: F.struct(network_of(u).alias("network"), F.concat(F.lit("https://"), u).alias("url"))),
                     lambda p: p["network"].isNotNull())
    once = tx.let(found, lambda ps: F.transform(
        F.array_distinct(F.transform(ps, lambda p: F.lower(p["url"]))),
        lambda low: _first(F.filter(ps, lambda p: F.lower(p["url"]) == low))))
    return docs.select(key, F.posexplode(once).alias("ord", "p")).select(key, "ord", "p.network", "p.url")


def _bounds(lines: Column, words: str) -> Column:
    """Struct ``(start, end)``, 0-based: first header of the kind and the next header of any kind; null without."""
    starts = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(_header(words)), i)), lambda i: i.isNotNull())
    heads = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(_ANY_HEADER), i)), lambda i: i.isNotNull())
    return tx.let(_first(starts), lambda s: F.when(s.isNotNull(), F.struct(
        s.alias("start"), F.coalesce(_first(F.filter(heads, lambda h: h > s)), F.size(lines)).alias("end"))))


def section_bounds(docs: DataFrame, key: str = "doc_id", layout: str = "pdf") -> DataFrame:
    """``(key, kind, start, end)`` over the lines of the layout."""
    lines = _nonblank(F.col("lines")) if layout == "pdf" else F.col("lines")
    rows = F.array(*[F.struct(F.lit(kind).alias("kind"), _bounds_of(lines, words).alias("b")) for kind, words in _HEADERS.items()])
    return docs.select(key, F.inline(rows)).filter("b is not null").select(key, "kind", "b.start", "b.end")


def _bounds_of(lines: Column, words: str) -> Column:
    return tx.let(lines, lambda ls: _bounds(ls, words))


def _body(lines: Column, words: str) -> Column:
    return tx.let(lines, lambda ls: tx.let(_bounds(ls, words), lambda b: F.when(
        b.isNotNull(), F.slice(ls, b["start"] + 2, F.greatest(b["end"] - b["start"] - 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))))


def _blocks(body: Column) -> Column:
    """Trimmed non-blank lines of each block; blank lines separate blocks."""
    marked = F.array_join(F.transform(body, lambda x: F.when(tx.is_blank(x), F.lit("\u0001")).otherwise(F.concat(tx.trim_space(x), F.lit("\u0002")))), "")
    parts = F.filter(F.split(marked, "\u0001+"), lambda p: p != "")
    return F.transform(parts, lambda p: F.filter(F.split(p, "\u0002"), lambda x: x != ""))


def _dots(line: Column) -> Column:
    return F.filter(F.transform(F.split(line, "·"), tx.trim_space), lambda p: p != "")


def _cells(block: Column) -> Column:
    """Each line with its position, dotted parts (if two or more) and date ranges."""
    def dates(x: Column) -> Column:
        return F.filter(F.array(F.struct(F.regexp_extract(x, _DATES, 1).alias("a"), F.regexp_extract(x, _DATES, 2).alias("b"))), lambda d: d["a"] != "")

    return F.transform(block, lambda x, i: tx.let(_dots(x), lambda ps: F.struct(
        i.alias("i"), x.alias("x"), F.when(x.contains("·") & (F.size(ps) >= 2), ps).alias("parts"), dates(x).alias("own"),
        F.flatten(F.transform(ps, dates)).alias("in_parts"))))


def _start(found: Column) -> Column:
    return F.concat(_first(found)["a"], F.lit("-01"))


def _end(found: Column) -> Column:
    return F.concat(_first(F.filter(found, lambda d: F.length(d["b"]) == 4))["b"], F.lit("-12"))


def _work_entry(block: Column, layout: str) -> Column:
    def build(c: Column, h: Column) -> Column:
        before = lambda x: h.isNull() | (x["i"] < h["i"])
        other = F.filter(c, lambda x: ~x["i"].eqNullSafe(h["i"]))
        if layout == "pdf":
            found = F.flatten(F.transform(c, lambda x: F.when(x["i"].eqNullSafe(h["i"]), x["in_parts"]).otherwise(x["own"])))
            rest = F.filter(other, lambda x: F.size(x["own"]) == 0)
            start = _start(found)
            first_is_position = F.coalesce(before(_first(rest)), F.lit(False)) & (F.size(rest) > 0)
            more = F.when(first_is_position, F.slice(rest, 2, F.size(rest))).otherwise(rest)
            position = F.when(first_is_position, _first(rest)["x"])
            summary, highlights = _first(more)["x"], F.slice(more, 2, F.size(more))
        else:
            dated = F.filter(other, lambda x: before(x) & (F.size(x["own"]) > 0))
            own = F.flatten(F.transform(dated, lambda x: x["own"]))
            found = F.concat(own, F.coalesce(h["in_parts"], F.array().cast("array<struct<a:string,b:string>>")))
            start = F.when(F.size(own) > 0, F.concat(F.element_at(own, -1)["a"], F.lit("-01"))).otherwise(_start(found))
            position = _first(F.filter(other, lambda x: before(x) & (F.size(x["own"]) == 0)))["x"]
            summary, highlights = F.lit(None).cast("string"), F.filter(other, lambda x: ~before(x))
        return F.struct(
            _first(h["parts"]).alias("company"), F.coalesce(F.get(h["parts"], F.lit(1)), position).alias("position"),
            start.alias("start"), _end(found).alias("end"), summary.alias("summary"),
            F.transform(highlights, lambda x: x["x"]).alias("highlights"))

    return tx.let(_cells(block), lambda c: tx.let(_first(F.filter(c, lambda x: x["parts"].isNotNull())), lambda h: build(c, h)))


def _lines_of(layout: str) -> Column:
    return _nonblank(F.col("lines")) if layout == "pdf" else F.col("lines")


def extract_work(docs: DataFrame, key: str = "doc_id", layout: str = "pdf") -> DataFrame:
    """``(key, ord, name, position, start, end, summary, highlights)``."""
    entries = F.transform(_blocks(_body(_lines_of(layout), _HEADERS["work"])), lambda b: _work_entry(b, layout))
    entries = F.filter(entries, lambda e: e["company"].isNotNull() | e["position"].isNotNull())
    return docs.select(key, F.posexplode(entries).alias("ord", "e")).select(
        key, "ord", F.coalesce("e.company", F.lit("Unknown")).alias("name"), F.coalesce("e.position", F.lit("Unknown")).alias("position"),
        F.coalesce("e.start", F.lit("1970-01")).alias("start"), F.col("e.end").alias("end"), "e.summary", "e.highlights")


def _education_entry(block: Column) -> Column:
    def build(c: Column, k: Column) -> Column:
        found = F.flatten(F.transform(c, lambda x: F.when(x["i"].eqNullSafe(k["i"]), F.when(x["parts"].isNotNull(), x["in_parts"]).otherwise(x["own"])).otherwise(x["own"])))
        return F.struct(
            F.coalesce(_first(k["parts"]), k["x"]).alias("institution"),
            F.array_join(F.slice(k["parts"], 2, F.size(k["parts"])), " · ").alias("area"),
            _start(found).alias("start"), _end(found).alias("end"))

    first = lambda c: _first(F.filter(c, lambda x: x["parts"].isNotNull() | (F.size(x["own"]) == 0)))
    return tx.let(_cells(block), lambda c: tx.let(first(c), lambda k: build(c, k)))


def extract_education(docs: DataFrame, key: str = "doc_id", layout: str = "pdf") -> DataFrame:
    """``(key, ord, institution, area, start, end)``."""
    entries = F.transform(_blocks(_body(_lines_of(layout), _HEADERS["education"])), _education_entry)
    entries = F.filter(entries, lambda e: e["institution"].isNotNull())
    return docs.select(key, F.posexplode(entries).alias("ord", "e")).select(
        key, "ord", "e.institution", "e.area", F.coalesce("e.start", F.lit("1970-01")).alias("start"), F.col("e.end").alias("end"))


def extract_skills(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, ord, name)``."""
    joined = F.array_join(_body(_nonblank(F.col("lines")), _HEADERS["skills"]), " ")
    names = F.filter(F.transform(F.split(joined, "[,;•·]"), tx.trim_space), lambda x: x != "")
    return docs.select(key, F.posexplode(names).alias("ord", "name"))


def extract_projects(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, ord, name, highlights)`` of the blocks of the project section."""
    blocks = _blocks(_body(F.col("lines"), PROJECT_HEADERS))
    return docs.select(key, F.posexplode(blocks).alias("ord", "b")).select(
        key, "ord", F.get("b", F.lit(0)).alias("name"), F.slice("b", F.lit(2), F.size("b")).alias("highlights"))


def mark_confidence(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Confidence of the basic fields and the warning of texts without any section header."""
    basics = extract_basics(docs, key)
    n = extract_profiles(docs, key).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    heads = docs.select(key, F.exists("lines", lambda x: x.rlike(_ANY_HEADER)).alias("_any"))
    mark = lambda ok: F.when(F.coalesce(ok, F.lit(False)), "Explicit").otherwise("Inferred")
    return basics.join(heads, key).join(n, key, "left").select(
        key, F.lit("Inferred").alias("name"), mark(F.col("email").rlike(_EMAIL)).alias("email"), mark(F.col("phone").rlike(_PHONE)).alias("phone"),
        mark(F.lower("url").startswith("http")).alias("url"), mark(F.col("_n") > 0).alias("profiles"),
        F.when(~F.col("_any"), "PDF_NO_SEMANTIC_STRUCTURE").alias("warning"))


#: Words of a page from which it is spread over tasks. Fewer pass through one, of which a line is held.
FULL_PAGE = 1_000_000


def words_to_lines(words: DataFrame, tol: float = 2.0, key: str = "doc_id") -> DataFrame:
    """``(key, page, line, text)`` from ``(key, page, x, y, text)``.

    Words are read from top to bottom; a line holds the words within ``tol`` of its first word's height, so
    the anchor moves only with a new line. Lines are numbered from 0; the words of a line are ordered by place and
    text. Words without a height are left out. A page is never held in one row, only a line is: words are shuffled once,
    by page, and read in order of their height, but for those of very full pages, which are spread over many tasks.
    Sizes of pages are stored.
    """
    place = F.struct(F.col(key).alias("key"), F.col("page").alias("page"))
    rows = words.filter(F.col("y").isNotNull()).select(place.alias("_k"), F.col("x").cast("double").alias("x"), "text", (-F.col("y").cast("double")).alias("_ny"))
    sizes = stored(rows.groupBy("_k").agg(F.count(F.lit(1)).alias("_n")), "page-sizes")
    full = sizes.filter(F.col("_n") > FULL_PAGE).select("_k")
    some = not full.isEmpty()
    rest = (rows.join(full, "_k", "left_anti") if some else rows).hint("merge").join(sizes.filter(F.col("_n") <= FULL_PAGE), "_k")
    opens = F.row_number().over(Window.partitionBy("_k").orderBy("_ny")) == 1
    kinds = T.StructType([rows.schema["_k"], T.StructField("line", T.IntegerType()), T.StructField("words", T.ArrayType(T.StructType([rows.schema["x"], rows.schema["text"]])))])
    lines = rest.select("_k", "_ny", opens.alias("_first"), "x", "text").mapInArrow(_in_lines(float(tol)), kinds)
    text = F.array_join(F.transform(F.array_sort("words"), lambda w: w["text"]), " ")
    out = lines.select(F.col("_k.key").alias(key), "_k.page", "line", text.alias("text"))
    if not some:
        return out
    wide = rows.join(full, "_k").select(F.col("_k.key").alias(key), "_k.page", "x", "text", "_ny")
    return out.unionByName(_lines_of_full_pages(wide, tol, key))


def _in_lines(tol: float):
    """Arrow function from words in order of their height, page by page, to lines with their words."""

    def in_lines(batches):
        held, line, limit = None, 0, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            # the open line comes first again; its words are known to follow its first one
            begun = held.num_rows if held is not None else 0
            starts, numbers = ([0], [line]) if begun else ([], [])
            for i, (first, height) in enumerate(zip(batch.column("_first").to_pylist(), batch.column("_ny").to_pylist()), begun):
                if first or height > limit or height != height and limit == limit:
                    line = 0 if first else line + 1
                    limit = height + tol
                    starts.append(i)
                    numbers.append(line)
            if begun:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            held = batch.slice(starts[-1])
            if len(starts) > 1:
                yield _lines(batch, starts, numbers[:-1])
        if held is not None:
            yield _lines(held, [0, held.num_rows], [line])

    return in_lines


def _lines(batch, starts: list[int], numbers: list[int]):
    """The lines of a batch between ``starts``, one row each."""
    words = pa.StructArray.from_arrays([batch.column("x"), batch.column("text")], ["x", "text"])
    return pa.RecordBatch.from_arrays([
        batch.column("_k").take(pa.array(starts[:-1], pa.int64())), pa.array(numbers, pa.int32()),
        pa.ListArray.from_arrays(pa.array(starts, pa.int32()), words)], ["_k", "line", "words"])


def _lines_of_full_pages(rows: DataFrame, tol: float, key: str) -> DataFrame:
    """The same for words ``(key, page, x, text, _ny)`` of pages too full for one task: first words of lines are found by
    :func:`openers`, all others by their place among them."""
    opened = openers(rows, [key, "page"], "_ny", float(tol), strict=True)
    numbered = opened.withColumn("line", F.row_number().over(Window.partitionBy(key, "page").orderBy("_ny")) - 1)
    numbered = numbered.select(F.col(key).alias("_k"), F.col("page").alias("_p"), F.col("_ny").alias("_first"), "line")
    heights = rows.select(key, "page", "_ny").distinct()
    same = heights[key].eqNullSafe(numbered["_k"]) & heights["page"].eqNullSafe(numbered["_p"]) & (heights["_ny"] == numbered["_first"])
    marked = heights.hint("merge").join(numbered, same, "left").select(key, "page", "_ny", F.col("line").alias("_line"))
    lines = running(marked, [key, "page"], ["_ny"], F.floor(F.col("_ny") / max(float(tol), 1.0)), [Running("line", "last", F.col("_line"))])
    lines = lines.select(F.col(key).alias("_k"), F.col("page").alias("_p"), F.col("_ny").alias("_h"), "line")
    placed = rows.hint("merge").join(lines, rows[key].eqNullSafe(lines["_k"]) & rows["page"].eqNullSafe(lines["_p"]) & (rows["_ny"] == lines["_h"]))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("x").cast("double").alias("x"), "text"))), lambda w: w["text"]), " ")
    return placed.groupBy(key, "page", "line").agg(text.alias("text"))
