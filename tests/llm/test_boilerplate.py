"""Boilerplate lines with the parameters in use: they go from kept texts, and depleted documents go."""

import corpus_pipeline
from docspark.llm import quality

LINES = [" ".join(f"Shared{c}{k}" for k in range(6)).replace(" ", "  ", 1) for c in "abcdefghijklmnop"]


def own(i, n):
    return " ".join(f"w{i}x{k}" for k in range(n))


def table(spark, n):
    """``n`` documents with two shared lines, one that is little but shared lines, and clean ones on another host."""
    rows = [(i, f"{LINES[0]}\n\n{own(i, 60)}\n{LINES[1].upper()} ", "h") for i in range(n)]
    rows += [(n + i, f"{own(n + i, 70)}\n" + "\n".join(LINES[2:]), "h") for i in range(n)]
    rows += [(9000, "\n".join(LINES) + "\nfew own words", "h"), (9001, f"{LINES[0]}\n{own(1, 60)}", "g"), (9002, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)


def test_depleted_with_defaults(spark):
    got = {r.doc_id: r for r in quality.quality_verdicts(table(spark, 9)).collect()}
    assert got[9000].removed_words == 96 and not got[9000].base_failed and not got[9000].kept
    assert got[9001].removed_words == 0 and got[9001].kept and all(got[i].kept for i in range(18))


def test_texts_without_boilerplate(spark):
    docs = table(spark, 9)
    got = {r.doc_id: r for r in quality.keep_clean(docs).collect()}
    assert quality.keep_clean(docs).columns == docs.columns
    assert sorted(got) == [*range(18), 9001]
    assert all(got[i].text == f"\n{own(i, 60)}" for i in range(9)) and all(got[i].text == own(i, 70) for i in range(9, 18))
    assert got[9001].text == f"{LINES[0]}\n{own(1, 60)}" and got[9001].source == "g"


def test_stage_removes_lines(spark, tmp_path):
    got = {r.doc_id: r.text for r in corpus_pipeline.quality_rules(spark, table(spark, 9), str(tmp_path)).collect()}
    assert sorted(got) == [*range(18), 9001] and got[5] == f"\n{own(5, 60)}"


def test_limit_is_absolute(spark):
    """A line in more than eight texts of a host goes however many the host has; exact copies count once."""
    rows = [(i, f"{LINES[0]}\n{own(i, 60)}" if i < 9 else f"{LINES[1]}\n{own(9, 60)}" if i < 40 else own(i, 60), "h") for i in range(400)]
    got = {r.doc_id: r.removed_words for r in quality.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert {i for i, n in got.items() if n} == set(range(9))


def test_long_text_and_null_host(spark):
    """A text of two megabytes in one line, hosts of null, nearly equal lines of other words."""
    rows = [(i, f"{'ab' * 2**i}\n{'ab' * 2**i} {own(0, 9)}", None) for i in range(12)] + [(50, own(5, 200_000), None), (51, "x y\nx  Y\n", None)]
    got = {r.doc_id: r for r in quality.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[50].n_words == 200_000 and got[50].kept and got[51].n_dup_lines == 0 and all(r.removed_words == 0 for r in got.values())
