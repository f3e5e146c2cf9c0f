"""Collocations against counting all phrases in plain Python."""

import collections
import random
import re

import pytest

from docspark.llm import collocations

SCHEMA = "doc_id long, lang string, text string, weight string, h1 string, word string"


def by_counting(rows, most=3, least=10, covered=50, top=2000):
    counts, total = collections.Counter(), collections.Counter()
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(low)):
            w = re.findall(r"[^ \t]+", piece)
            total[lang] += len(w)
            for k in range(1, most + 1):
                counts.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    frequent = {q: a for q, a in counts.items() if a >= least and len(q[1]) > 1}
    inside = {
        (lang, p[i : i + k]) for (lang, p), a in frequent.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= covered * frequent[lang, p[i : i + k]]
    }
    found = collections.defaultdict(list)
    for (lang, p), a in frequent.items():
        if (lang, p) not in inside:
            f = lambda q, lang=lang: counts[lang, q]
            score, k = min((1_000_000 * a * a // (f(p[:k]) * f(p[k:])), k) for k in range(1, len(p)))
            found[lang].append((-score, -a, " ".join(p).encode(), f(p[:k]), f(p[k:])))
    return sorted(
        (lang, i, phrase.decode(), -a, left, right, total[lang], -s) for lang, rows in found.items() for i, (s, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1)
    )


def frame(spark, rows):
    return spark.createDataFrame([(i, lang, text, "x", None, "y") for i, (lang, text) in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("seed,most,least,top", [(1, 3, 10, 2000), (2, 4, 3, 25), (3, 2, 2, 2000), (4, 3, 1, 7)])
def test_against_counting(spark, seed, most, least, top):
    r = random.Random(seed)
    words = ["a", "A", "b", "été", "ÉTÉ", "x#", "zz", "q r", "漢", "tab"]
    marks = [" ", " ", " ", "  ", "\t", " , ", ". ", "\n", "\r", "\x0b", ":"]
    texts = ["".join(r.choice(words) + r.choice(marks) for _ in range(r.randrange(60))) for _ in range(40)]
    rows = [(r.choice(["en", "fr", None, "", "und"]), r.choice(texts)) for _ in range(90)] + [("en", None), (None, ""), ("de", " \t "), ("en", ".,;")]
    out = collocations.collocations(frame(spark, rows).repartition(3), most=most, least=least, top=top).collect()
    assert sorted(tuple(x)[:8] for x in out) == by_counting(rows, most, least, top=top)


def test_long_passage_is_one_stretch(spark):
    passage = [f"w{i}" for i in range(300)]
    rows = [("en", f"s{i} " + " ".join(passage) + f" t{i}") for i in range(12)] + [("en", "w7 w8 other")] * 40
    out = collocations.collocations(frame(spark, rows))
    got = {x["phrase"]: x["path_words"] for x in out.collect()}
    assert sorted(tuple(x)[:8] for x in out.collect()) == by_counting(rows)
    assert got["w100 w101 w102"] == 300 - 7  # from the branch at w7 w8 to the end
    assert got["w1 w2 w3"] == 9


def test_ties_and_short_tables(spark):
    rows = [("en", f"k{i} m{i} ") for i in range(30) for _ in range(11)]
    out = collocations.collocations(frame(spark, rows), top=20).collect()
    assert [x["phrase"] for x in sorted(out, key=lambda x: x["rank"])] == sorted(f"k{i} m{i}" for i in range(30))[:20]
    assert collocations.collocations(frame(spark, [])).collect() == []
    assert collocations.collocations(frame(spark, [(None, None)])).collect() == []


def test_scores_beyond_64_bits(spark):
    n = 10**12
    df = spark.createDataFrame([(n, n + 1, n + 3)], "a long, l long, r long")
    assert df.select(collocations._score(df["a"], df["l"], df["r"])).first()[0] == 1_000_000 * n * n // ((n + 1) * (n + 3))


@pytest.mark.parametrize("named", [0, 10**6])
def test_words_by_name_or_hash(spark, monkeypatch, named):
    """Where the words have names a phrase is one number in the shuffle; either way the rows are those of plain counting."""
    monkeypatch.setattr(collocations, "NAMED", named)
    r = random.Random(8)
    words = [f"v{i}" for i in range(30)] + [f"rare{i}" for i in range(400)]
    rows = [(r.choice(["en", "fr"]), " ".join(r.choice(words[:30] if r.random() < 0.9 else words) for _ in range(60))) for _ in range(60)]
    docs = frame(spark, rows).repartition(3)
    assert sorted(tuple(x)[:8] for x in collocations.collocations(docs, least=4).collect()) == by_counting(rows, least=4)
    plan = collocations.graph(docs.select("lang", "text"), 3, 4)._jdf.queryExecution().executedPlan().toString()
    assert ("hashpartitioning(lang" in plan) and (("phrase#" in plan) == (named > 0))


def test_words_are_sent_by_few_tasks(spark, monkeypatch):
    """Rows that spell words go with the number of words, not with that of tasks times words."""
    r = random.Random(12)
    words = [f"v{i}" for i in range(300)]
    rows = [(r.choice(["en", "fr"]), " ".join(r.choice(words) for _ in range(100))) for _ in range(640)]
    texts = frame(spark, rows).repartition(16).select("lang", "text")
    sent, plain = [], type(texts).mapInArrow

    def counted(self, *args, **options):
        out = plain(self, *args, **options)
        sent.append(out)
        return out

    with monkeypatch.context() as m:
        m.setattr(type(texts), "mapInArrow", counted)
        found = collocations.joined_words(texts, 3, None)
    assert sorted(x["word"] for x in found.collect()) == sorted(words)
    assert sum(x.count() for x in sent) <= 8 * len(words)
