"""Structure of long technical documents: sections, paragraphs, claims, passages.

Spark gives no match offsets, and rebuilding them from splits takes two passes over the text for each pattern. So headers,
paragraph and claim marks come from one Arrow function over whole batches, with the text up to the next mark; all else is column
expressions.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findling.functions import text as tx

# Section headers, transitional phrases and claim marks, as patterns.
_HEADERS = {
    "ABSTRACT": r"ABSTRACT",
    "CROSS_REFERENCE": r"(?:CROSS[- ]REFERENCE TO RELATED APPLICATIONS?|RELATED APPLICATIONS?)",
    "FIELD_OF_INVENTION": r"(?:FIELD OF (?:THE )?INVENTION|TECHNICAL FIELD)",
    "BACKGROUND": r"(?:BACKGROUND OF (?:THE )?INVENTION|BACKGROUND|DESCRIPTION OF (?:THE )?RELATED ART|PRIOR ART)",
    "SUMMARY": r"(?:SUMMARY OF (?:THE )?INVENTION|BRIEF SUMMARY(?: OF (?:THE )?INVENTION)?|OBJECTS? OF (?:THE )?INVENTION|SUMMARY\b)",
    "DRAWINGS_DESCRIPTION": r"(?:BRIEF DESCRIPTION OF (?:THE )?(?:DRAWINGS|FIGURES)|DESCRIPTION OF (?:THE )?DRAWINGS)",
    "DETAILED_DESCRIPTION": r"(?:DETAILED DESCRIPTION(?: OF (?:THE )?(?:PREFERRED )?EMBODIMENTS?)?|BEST MODE FOR CARRYING OUT THE INVENTION)",
}
HEADER_PATTERNS = {k: rf"(?iU)(?:^|\n)\s*{v}\s*(?:\n|$)" for k, v in _HEADERS.items()} | {"CLAIMS": r"(?iU)(?:^|\n)\s*(?:WHAT IS CLAIMED IS|WE CLAIM|I CLAIM|CLAIMS\b)\s*[:\n\r]+"}
#: Capitals of which each header has one; letters with further cases (I, K) are left out.
HEADER_KEYS = {
    "ABSTRACT": ("ABSTRACT",), "CROSS_REFERENCE": ("RELATED APPL",), "FIELD_OF_INVENTION": ("ELD",), "BACKGROUND": ("GROUND", "RELATED ART", "OR ART"), "SUMMARY": ("SUMMARY", "OBJECT"),
    "DRAWINGS_DESCRIPTION": ("DESCR",), "DETAILED_DESCRIPTION": ("DETA", "BEST MODE"), "CLAIMS": ("CLA",),
}
TRANSITIONS = ("comprising", "comprises", "consisting of", "consists of", "consisting essentially of", "characterized in that", "characterized by", "including", "composed of")
PARAGRAPH_MARK = r"(?U)(?:^|\n)\s*(\[\d{4}\]|\(\d{4}\))\s*"
CLAIM_MARK = r"(?U)(?:^|\n)\s*(?:Claim\s+)?(\d+)[.:]\s+"
CLAIM_END = r"(?U)\n\s*(?:[A-Z\s]{5,}:|Dated:|Inventor Signature)"
CITED_CLAIM = r"(?iU)(?:claim|claims)\s+(\d+)"
LIMITATION_CUT = r"(?U);|\n\s*[-–•]|\n\s*\([a-z\d]+\)"

SECTIONS = "array<struct<segment_id:string,segment_type:string,heading:string,start_char:int,end_char:int,text:string,word_count:int,fallback:boolean>>"
PARAGRAPHS = "array<struct<segment_id:string,heading:string,start_char:int,end_char:int,text:string,word_count:int,section_affinity:string,fallback_split:boolean>>"


def kept(rows: DataFrame) -> DataFrame:
    """Rows as they are, behind a row counter. The optimizer would otherwise put the definition of an array column into every
    lambda that reads it, and so compute it for each element."""
    return rows.observe(f"segment-{uuid.uuid4().hex[:12]}", F.count(F.lit(1)).alias("n"))


def _machine(pattern: str) -> re.Pattern:
    return re.compile(pattern.replace("U)", ")", 1).replace("(?)", "", 1))


_MARKS = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string()), ("heading", pa.string()), ("text", pa.string()), ("word_count", pa.int32())])
_MARK = "array<struct<start:int,stop:int,kind:string,heading:string,text:string,word_count:int>>"
_HELD = 1 << 20  # characters whose marks are Python objects at once


def _spans(text: str, end: int, machines: list[tuple[str, tuple[str, ...], re.Pattern]]) -> list[tuple]:
    """All matches of each pattern, by start, then by the order of the patterns: start, stop, kind, heading, text, words. A match
    has the text from its end to the start of the next one (the last one: to `end`), stripped."""
    capitals = text.upper() if any(keys for _, keys, _ in machines) else ""
    found = []
    for n, (kind, keys, machine) in enumerate(machines):
        if not keys or any(k in capitals for k in keys):
            found.extend((m.start(), n, m.end(), kind, m.group()) for m in machine.finditer(text))
    found.sort()
    nexts = [x[0] for x in found[1:]] + [end]
    bodies = [text[x[2] : stop].strip() for x, stop in zip(found, nexts, strict=False)]
    return [(start, stop, kind, heading.strip(), body, len(body.split())) for (start, _, stop, kind, heading), body in zip(found, bodies, strict=True)]


def _as_arrow(rows: list[list[tuple] | None]) -> pa.Array:
    flat, offsets, total = [x for own in rows if own for x in own], [], 0
    for own in rows:
        offsets.append(None if own is None else total)
        total += len(own or ())
    columns = list(zip(*flat, strict=True)) or [()] * len(_MARKS)
    return pa.ListArray.from_arrays(pa.array([*offsets, total], pa.int32()), pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _MARKS, strict=True)], fields=list(_MARKS)))


def marks(body: Column, stop_at_claims: bool = False) -> Column:
    """struct<sections, paragraphs, claims> of spans, and the `end` of the last paragraph, all from one pass of a text through
    Python; null gives nulls. Claims are looked for in the first claims section, or else after the first claims header.
    Texts are taken a bounded number of characters at a time, so that only Arrow's own columns grow with a batch."""
    headers = [(kind, HEADER_KEYS.get(kind, ()), _machine(p)) for kind, p in HEADER_PATTERNS.items()]
    numbered, numbers, header = [("PARAGRAPH", (), _machine(PARAGRAPH_MARK))], [("CLAIM", (), _machine(CLAIM_MARK))], _machine(HEADER_PATTERNS["CLAIMS"])
    kind = pa.struct([("sections", pa.list_(_MARKS)), ("paragraphs", pa.list_(_MARKS)), ("claims", pa.list_(_MARKS)), ("end", pa.int32())])

    def of(text: str | None) -> tuple:
        if text is None:
            return None, None, [], None
        sections = _spans(text, len(text), headers)
        own = next((s for s in sections if s[2] == "CLAIMS"), None)
        end = min(len(text), own[0]) if own and stop_at_claims else len(text)
        claims = "" if own is None else own[4] or (header.split(text, 1)[1:] or [""])[0]
        return sections, _spans(text, end, numbered), _spans(claims, len(claims), numbers), end

    def find(texts: pa.Array) -> pa.Array:
        parts, at, size = [], 0, 0
        held: list[tuple] = []
        while at < len(texts):
            while at < len(texts) and (not held or size < _HELD):
                text = texts[at].as_py()
                held.append(of(text))
                at, size = at + 1, size + len(text or "")
            columns = list(zip(*held, strict=True))
            parts.append(pa.StructArray.from_arrays([*(_as_arrow(list(c)) for c in columns[:3]), pa.array(columns[3], pa.int32())], fields=list(kind)))
            held, size = [], 0
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return F.arrow_udf(find, f"struct<sections:{_MARK},paragraphs:{_MARK},claims:{_MARK},end:int>")(body)


def _count(c: Column) -> Column:
    return tx.word_count(c)


def marked(docs: DataFrame, stop_at_claims: bool = False) -> DataFrame:
    """Adds `body` (text with LF line ends) and `_found`, its marks, to docs(..., full_text)."""
    body = kept(docs.withColumn("body", tx.unix_lines(F.col("full_text"))))
    return kept(body.withColumn("_found", marks(F.col("body"), stop_at_claims)))


def with_sections(docs: DataFrame) -> DataFrame:
    """Adds `sections` to marked()."""
    m, size = F.col("_found.sections"), F.length("body")

    def section(x: Column, i: Column) -> Column:
        stop = F.coalesce(F.get(m, i + 1)["start"], size)
        return F.struct(F.format_string("SEC-%03d", i + 1).alias("segment_id"), x["kind"].alias("segment_type"), x["heading"].alias("heading"), x["start"].alias("start_char"), stop.alias("end_char"), x["text"].alias("text"), x["word_count"].alias("word_count"), F.lit(False).alias("fallback"))

    def whole(name: str, heading: str, end: Column, fallback: bool) -> Column:
        own = tx.strip(F.substring(F.col("body"), F.lit(1), end))
        return F.struct(F.lit(name).alias("segment_id"), F.lit("OTHER").alias("segment_type"), F.lit(heading).alias("heading"), F.lit(0).alias("start_char"), end.alias("end_char"), own.alias("text"), _count(own).alias("word_count"), F.lit(fallback).alias("fallback"))

    first = F.get(m, F.lit(0))["start"]
    lead = (first > 100) & (F.length(tx.strip(F.substring(F.col("body"), F.lit(1), first))) > 30)
    found = F.concat(F.when(lead, F.array(whole("SEC-000", "PREAMBLE", first, False))).otherwise(F.array().cast(SECTIONS)).cast(SECTIONS), F.transform(m, section).cast(SECTIONS))
    return kept(docs.withColumn("sections", F.when(F.size(m) > 0, found).otherwise(F.array(whole("SEC-001", "BODY", size, True)).cast(SECTIONS))))


def with_paragraphs(docs: DataFrame) -> DataFrame:
    """Adds `paragraphs`: numbered ones if there are two at least, else blocks between empty lines outside the claims. The last
    numbered paragraph runs to the end of the text; with stop_at_claims, to the claims."""
    sections, m = F.col("sections"), F.col("_found.paragraphs")

    def numbered(x: Column, i: Column) -> Column:
        stop = F.coalesce(F.get(m, i + 1)["start"], F.col("_found.end"))
        home = F.get(F.filter(sections, lambda s: x["start"].between(s["start_char"], s["end_char"])), F.lit(0))["segment_type"]
        return F.struct(F.concat(F.lit("PAR-"), F.translate(x["heading"], "[]()", "")).alias("segment_id"), x["heading"].alias("heading"), x["start"].alias("start_char"), stop.alias("end_char"), x["text"].alias("text"), x["word_count"].alias("word_count"), F.coalesce(home, F.lit("DETAILED_DESCRIPTION")).alias("section_affinity"), F.lit(False).alias("fallback_split"))

    outside = F.filter(sections, lambda s: s["segment_type"] != "CLAIMS")
    blocks = F.flatten(F.transform(outside, lambda s: F.transform(F.filter(F.transform(F.split(s["text"], r"(?U)\n\s*\n"), tx.strip), lambda b: F.length(b) > 60), lambda b: F.struct(b.alias("text"), s["segment_type"].alias("home")))))

    def plain(x: Column, i: Column) -> Column:
        return F.struct(F.format_string("PAR-%04d", i + 1).alias("segment_id"), F.format_string("Paragraph %d", i + 1).alias("heading"), F.lit(0).alias("start_char"), F.length(x["text"]).alias("end_char"), x["text"].alias("text"), _count(x["text"]).alias("word_count"), x["home"].alias("section_affinity"), F.lit(True).alias("fallback_split"))

    own = F.filter(F.transform(m, numbered).cast(PARAGRAPHS), lambda p: p["text"] != "")
    return kept(docs.withColumn("paragraphs", F.when(F.size(m) >= 2, own).otherwise(F.transform(blocks, plain).cast(PARAGRAPHS))))


def with_claims(docs: DataFrame) -> DataFrame:
    """Adds `claims`: number, text, kind, cited claims, preamble, transitional phrase and limitations of each claim."""
    parts = F.transform("_found.claims", lambda m: F.struct(F.regexp_extract(m["heading"], r"(?U)\d+", 0).try_cast("long").alias("claim_id"), tx.strip(F.get(F.split(m["text"], CLAIM_END, 2), F.lit(0))).alias("text")))
    split = kept(docs.withColumn("_parts", F.filter(parts, lambda c: c["claim_id"].isNotNull() & (c["text"] != ""))).drop("_found"))

    def phrase(c: Column) -> Column:
        out = F.lit("")
        for p in reversed(TRANSITIONS):
            out = F.when(c.rlike(rf"(?iU)\b{p}\b"), F.lit(p)).otherwise(out)
        return out

    phrased = kept(split.withColumn("_phrased", F.transform("_parts", lambda c: F.struct(c["claim_id"].alias("claim_id"), c["text"].alias("text"), phrase(c["text"]).alias("phrase")))))

    def around(c: Column) -> Column:
        return F.when(c["phrase"] == "", F.array(F.lit(""), F.lit(""))).otherwise(F.split(c["text"], F.concat(F.lit(r"(?iU)\b"), c["phrase"], F.lit(r"\b")), 2))

    sided = kept(phrased.withColumn("_sided", F.transform("_phrased", lambda c: F.struct(*(c[k].alias(k) for k in ("claim_id", "text", "phrase")), around(c).alias("sides")))))

    def claim(c: Column) -> Column:
        parents = F.array_sort(F.array_distinct(F.filter(F.transform(F.regexp_extract_all(c["text"], F.lit(CITED_CLAIM), F.lit(1)), lambda x: x.try_cast("long")), lambda x: x != c["claim_id"])))
        before = tx.strip(F.get(c["sides"], F.lit(0)))
        after = tx.strip(F.regexp_replace(tx.strip(F.get(c["sides"], F.lit(1))), "^:+", ""))
        limits = F.filter(F.transform(F.split(after, LIMITATION_CUT), tx.strip), lambda x: F.length(x) > 10)
        limits = F.when(before == "", F.array(c["text"])).otherwise(limits)
        return F.struct(
            F.format_string("CLM-%03d", c["claim_id"]).alias("segment_id"), c["claim_id"].cast("int").alias("claim_id"), F.when(F.size(parents) > 0, "DEPENDENT").otherwise("INDEPENDENT").alias("claim_type"), parents.cast("array<int>").alias("parent_claims"),
            F.when(before == "", tx.strip(F.split_part(c["text"], F.lit(","), F.lit(1)))).otherwise(before).alias("preamble"), c["phrase"].alias("transitional_phrase"), limits.alias("limitations"), F.size(limits).alias("limitations_count"), c["text"].alias("text"), _count(c["text"]).alias("word_count"),
        )

    return kept(sided.withColumn("claims", F.transform("_sided", claim)).drop("_parts", "_phrased", "_sided"))


def segmented(docs: DataFrame, stop_at_claims: bool = False) -> DataFrame:
    """docs(doc_id, title, abstract, full_text) with sections, paragraphs, claims and stats."""
    out = with_claims(with_paragraphs(with_sections(marked(docs, stop_at_claims))))
    stats = F.struct(
        F.length("body").alias("total_chars"), _count(F.col("body")).alias("total_words"), F.size("sections").alias("section_count"), F.size("paragraphs").alias("paragraph_count"), F.size("claims").alias("claim_count"),
        F.size(F.filter("claims", lambda c: c["claim_type"] == "INDEPENDENT")).alias("independent_claims"), F.size(F.filter("claims", lambda c: c["claim_type"] == "DEPENDENT")).alias("dependent_claims"),
    )
    return out.withColumn("title", tx.strip(tx.present(F.col("title")))).withColumn("abstract", tx.strip(tx.present(F.col("abstract")))).withColumn("stats", stats)


def sections_of(segments: DataFrame) -> DataFrame:
    return segments.select("doc_id", F.inline("sections"))


def paragraphs_of(segments: DataFrame) -> DataFrame:
    return segments.select("doc_id", F.inline("paragraphs"))


def claims_of(segments: DataFrame) -> DataFrame:
    return segments.select("doc_id", F.inline("claims"))


def claim_edges(segments: DataFrame) -> DataFrame:
    """doc_id, claim_id, parent_id."""
    return claims_of(segments).select("doc_id", "claim_id", F.explode("parent_claims").alias("parent_id"))


def passage_rows() -> Column:
    """array<struct<passage_id, segment_type, text>> of all parts of a segmented document that can be searched for."""
    head = F.concat(F.lit("Title: "), F.col("title"), F.lit("\n"))

    def row(name: Column, kind: str, text: Column) -> Column:
        return F.struct(F.concat(F.col("doc_id").cast("string"), F.lit("-"), name).alias("passage_id"), F.lit(kind).alias("segment_type"), text.alias("text"))

    abstract = F.filter(F.array(row(F.lit("SEC-ABSTRACT"), "ABSTRACT", F.concat(head, F.lit("Abstract: "), F.col("abstract")))), lambda _: F.col("abstract") != "")
    paragraphs = F.transform("paragraphs", lambda p: row(p["segment_id"], "PARAGRAPH", F.concat(head, F.lit("["), F.when(p["heading"] != "", p["heading"]).otherwise("PARAGRAPH"), F.lit("]: "), p["text"])))
    claims = F.transform("claims", lambda c: row(c["segment_id"], "CLAIM", F.concat(head, F.lit("Claim "), c["claim_id"].cast("string"), F.lit(" ("), c["claim_type"], F.lit("): "), c["text"])))
    return F.concat(abstract, paragraphs, claims)


def passages(segments: DataFrame) -> DataFrame:
    """doc_id, passage_id, segment_type, text."""
    return segments.select("doc_id", F.inline(passage_rows()))


# What stands for a structure where there is no client, and where an answer cannot be read.
NOTICE = ("API client not initialized.", "Rule-based fallback representation.", "Unstructured text.")
FALLBACK = ("Extraction error: unreadable answer", "Fallback representation")


def structured(docs: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Problem, core, elements and claim summary of each document: a stored answer if there is one, else a fixed notice.
    answers(doc_id, raw): a model's JSON, perhaps in code fences."""
    from findling.schemas import STRUCTURE

    notice = F.struct(F.col("doc_id").cast("string").alias("doc_id"), F.lit(NOTICE[0]).alias("problem_statement"), F.lit(NOTICE[1]).alias("inventive_core"), F.array().cast("array<string>").alias("technical_elements"), F.lit(NOTICE[2]).alias("claim_summary"), F.lit(None).cast("string").alias("error"))
    if answers is None:
        return docs.select(notice.alias("s")).select("s.*")
    parsed = F.from_json(tx.without_fences(F.col("raw")), STRUCTURE)
    failed = F.struct(F.col("doc_id").cast("string").alias("doc_id"), F.lit(FALLBACK[0]).alias("problem_statement"), tx.present(F.col("title")).alias("inventive_core"), F.array().cast("array<string>").alias("technical_elements"), F.lit(FALLBACK[1]).alias("claim_summary"), F.lit("unreadable answer").alias("error"))
    good = F.coalesce(parsed["problem_statement"], parsed["inventive_core"], parsed["claim_summary"]).isNotNull()
    own = F.when(F.col("raw").isNull(), notice).when(good, parsed.withField("doc_id", F.col("doc_id").cast("string"))).otherwise(failed)
    return docs.join(answers.select("doc_id", "raw"), "doc_id", "left").select(own.alias("s")).select("s.*")
