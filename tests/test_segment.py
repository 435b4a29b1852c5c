"""Segmentation of a written sample and of edge cases."""

from findling.operators import segment

SAMPLE = (
    "\nWIDGET ALIGNMENT APPARATUS\n\nABSTRACT\nA widget aligner.\n\nBACKGROUND\n[0001] Old aligners drift.\n[0002] They are slow.\n\nCLAIMS\nWhat is claimed is:\n"
    "1. A widget aligner comprising:\na frame supporting widgets;\na sensor including a lens; and\na motor coupled to the frame.\n2. The aligner of claim 1, wherein the motor is a servo.\n"
    "Claim 3: The aligner of claims 1 and 2, consisting of steel parts only.\n"
)


def segments(spark, *texts):
    rows = spark.createDataFrame([(k, "T", "", t) for k, t in enumerate(texts)], "doc_id int, title string, abstract string, full_text string")
    return segment.segmented(rows).orderBy("doc_id").collect()


def test_sample(spark):
    (r,) = segments(spark, SAMPLE)
    assert [s.segment_type for s in r.sections] == ["ABSTRACT", "BACKGROUND", "CLAIMS"]
    assert [(p.segment_id, p.start_char, p.section_affinity) for p in r.paragraphs] == [("PAR-0001", 67, "BACKGROUND"), ("PAR-0002", 94, "BACKGROUND")]
    assert [c.parent_claims for c in r.claims] == [[], [1], [1]]
    assert [(c.transitional_phrase, c.limitations_count) for c in r.claims] == [("comprising", 3), ("", 1), ("consisting of", 1)]
    assert r.claims[0].preamble == "A widget aligner" and r.claims[1].preamble == "The aligner of claim 1"
    assert (r.stats.claim_count, r.stats.independent_claims, r.stats.dependent_claims) == (3, 1, 2)


def test_edges(spark):
    empty, crlf, early, late, single, ended = segments(
        spark, "", "SUMMARY\r\nSome words.\r\n", "x" * 99 + "\n\nABSTRACT\nbody", "y" * 101 + "\n\nABSTRACT\nbody", "[0001] one paragraph that is long enough to count as a block of text by itself, yes", "CLAIMS:\n1. comprising nothing but a thing, Dated\nDated: today\n2. A thing of claim 2."
    )
    assert [(s.heading, s.fallback, s.text) for s in empty.sections] == [("BODY", True, "")] and not empty.paragraphs and not empty.claims
    assert crlf.sections[0].segment_type == "SUMMARY" and crlf.sections[0].text == "Some words."
    assert [s.heading for s in early.sections] == ["ABSTRACT"]
    assert [s.heading for s in late.sections] == ["PREAMBLE", "ABSTRACT"]
    assert [p.fallback_split for p in single.paragraphs] == [True]
    assert [(c.claim_id, c.claim_type) for c in ended.claims] == [(1, "INDEPENDENT"), (2, "INDEPENDENT")]
    assert ended.claims[0].preamble == "comprising nothing but a thing" and ended.claims[0].transitional_phrase == "comprising"


def test_passages(spark):
    rows = spark.createDataFrame([(1, "T", "An abstract.", SAMPLE)], "doc_id int, title string, abstract string, full_text string")
    got = segment.passages(segment.segmented(rows)).collect()
    assert [r.passage_id for r in got] == ["1-SEC-ABSTRACT", "1-PAR-0001", "1-PAR-0002", "1-CLM-001", "1-CLM-002", "1-CLM-003"]
    assert got[3].text.startswith("Title: T\nClaim 1 (INDEPENDENT): A widget aligner")


def test_stored_structures(spark):
    docs = spark.createDataFrame([(1, "T"), (2, "U"), (3, "V")], "doc_id int, title string")
    answers = spark.createDataFrame([(1, '```json\n{"problem_statement": "p", "technical_elements": ["x"]}\n```'), (2, "not json")], "doc_id int, raw string")
    got = {r.doc_id: r for r in segment.structured(docs, answers).collect()}
    assert got["1"].problem_statement == "p" and got["1"].technical_elements == ["x"] and got["2"].error and got["3"].problem_statement == "API client not initialized."


def test_all_headers(spark):
    heads = ["Abstract", "CROSS-REFERENCE TO RELATED APPLICATIONS", "TECHNICAL FIELD", "PRIOR ART", "Objects of the Invention", "DESCRIPTION OF THE DRAWINGS", "BEST MODE FOR CARRYING OUT THE INVENTION", "I claim:"]
    kinds = ["ABSTRACT", "CROSS_REFERENCE", "FIELD_OF_INVENTION", "BACKGROUND", "SUMMARY", "DRAWINGS_DESCRIPTION", "DETAILED_DESCRIPTION", "CLAIMS"]
    lead = "A lead of the document, long enough to count as one, as it has well over a hundred characters before the first header. "
    text = lead + "\r\n" + "".join(f"\r\n{h}\r\nWords é of {k}.\r\n" for k, h in enumerate(heads)) + "1. A thing.\r\n1. A thing twice, comprising a part; and another part.\r\n3. The thing of claims 1-3.\r\n"
    full, near, none = segments(spark, text, "BACKGROUND\nABSTRACT\nABSTRACT\none two", None)
    assert [s.segment_type for s in full.sections] == ["OTHER", *kinds]
    assert [s.heading for s in full.sections] == ["PREAMBLE", *heads]
    assert [s.text for s in full.sections[1:8]] == [f"Words é of {k}." for k in range(7)] and {s.word_count for s in full.sections[1:8]} == {4}
    assert all(full.body[s.start_char : s.end_char].strip().startswith(s.heading) for s in full.sections[1:])
    assert [(c.claim_id, c.parent_claims) for c in full.claims] == [(1, []), (1, []), (3, [1])]
    # the newline between two headers serves both, but a pattern's own matches do not overlap
    assert [(s.segment_type, s.start_char, s.text) for s in near.sections] == [("BACKGROUND", 0, ""), ("ABSTRACT", 10, "ABSTRACT\none two")]
    assert [(s.heading, s.text) for s in none.sections] == [("BODY", "")] and none.stats.total_words == 0


def test_paragraphs_stop_at_claims(spark):
    text = "BACKGROUND\n[0001] First one.\n(0002) Second one.\n\nCLAIMS\n1. A thing.\n"
    rows = spark.createDataFrame([(1, "T", "", text)], "doc_id int, title string, abstract string, full_text string")
    open_end, closed = (segment.segmented(rows, stop).first().paragraphs for stop in (False, True))
    assert [p.segment_id for p in open_end] == ["PAR-0001", "PAR-0002"] == [p.segment_id for p in closed]
    assert open_end[1].text == "Second one.\n\nCLAIMS\n1. A thing." and open_end[1].word_count == 6 and closed[1].text == "Second one."


def test_control_characters_in_claims(spark):
    (r,) = segments(spark, "CLAIMS\n1. A \x01thing\x02 of parts.\nClaim 2: The thing of claim 1.\n")
    assert [(c.claim_id, c.text) for c in r.claims] == [(1, "A \x01thing\x02 of parts."), (2, "The thing of claim 1.")]


def test_one_pass_through_python(spark):
    rows = spark.createDataFrame([(1, "T", "", SAMPLE)], "doc_id int, title string, abstract string, full_text string")
    plan = segment.segmented(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1


def test_marks_do_not_depend_on_the_parts_of_a_batch(monkeypatch):
    import pyarrow as pa

    texts, found = pa.array([SAMPLE, None, "", "CLAIMS:\n\nCLAIMS:\n1. A thing.\n", "x" * 200, SAMPLE]), []
    monkeypatch.setattr(segment.F, "arrow_udf", lambda f, kind: lambda c: found.append(f))
    for held in (1, 300, 1 << 20):
        monkeypatch.setattr(segment, "_HELD", held)
        segment.marks(None)
        got = found[-1](texts)
        assert len(got) == len(texts)
        found[-1] = got
    assert found[0].equals(found[1]) and found[1].equals(found[2])
