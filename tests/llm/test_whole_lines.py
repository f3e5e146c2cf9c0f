"""Every line has a row, and edits are counted in characters."""

from docspark.llm import line_dedup


def test_short_lines(spark):
    docs = [(1, "Les.\nÍ.\n\nown"), (2, "Les.\n" + "x" * 45), (3, "Í."), (4, "Les!\nLes."), (5, "And therhean is the is esndha."), (6, "And therhaan is the is esnda.")]
    got = {(r.doc_id, r.line_no): r[2:] for r in line_dedup.near_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert got == {
        (1, 0): (1, 0, 0, True), (1, 1): (1, 1, 0, True), (1, 3): (1, 3, 0, True), (2, 0): (1, 0, 0, False), (2, 1): (2, 1, 0, True),
        (3, 0): (1, 1, 0, False), (4, 0): (4, 0, 0, True), (4, 1): (1, 0, 0, False), (5, 0): (5, 0, 1, True), (6, 0): (5, 0, 1, False),
    }


def test_edits_are_characters(spark):
    base = "Ces élèves déjà allés à la forêt étaient là, près du château 语言."
    lines = [base, base.replace("é", "e", 2), base.replace("语言", "文字"), base.replace("é", "e", 3), base.replace("语言", "")]
    got = {r.doc_id: r.n_links for r in line_dedup.near_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    assert got == {0: 3, 1: 2, 2: 2, 3: 1, 4: 2}
    # The third differs from the first by three letters, from the second by one.
    assert line_dedup.within([base.encode()] * 4, [x.encode() for x in lines[1:]], 2).tolist() == [True, True, False, True]
