"""The dual against bisection, and the mix against its targets."""

import math
import random

import pytest

from docspark.llm import mixing


def bisect(f, lo, hi):
    """Root of a decreasing function."""
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) > 0 else (lo, mid)
    return lo


def by_bisection(cells, targets, mean, most):
    """For each length multiplier the sources' multipliers have one solution each; so has the length constraint."""

    def sources(mu):
        out = {}
        for s, t in targets.items():
            own = [(z - mean, m) for x, z, m in cells if x == s]
            out[s] = bisect(lambda lam: t - sum(m * min(most, math.exp(lam + mu * z)) for z, m in own), -30, 60)  # noqa: B023
        return out

    def short(mu):
        lam = sources(mu)
        return -sum(m * min(most, math.exp(lam[s] + mu * (z - mean))) * (z - mean) for s, z, m in cells) - mixing.RIDGE * sum(targets.values()) * mu

    # ``bisect`` goes up while its function is positive, so falling functions of the multiplier have their root there.
    mu = bisect(short, -8, 8)
    return sources(mu), mu


@pytest.mark.parametrize("seed", range(3))
def test_dual(spark, seed):
    r = random.Random(seed)
    cells = [(s, z / 4, r.randrange(1, 2000)) for s in "abcd" for z in r.sample(range(12, 50), r.randrange(1, 9))]
    mass = {s: sum(m for x, _, m in cells if x == s) for s in "abcd"}
    targets = {s: m * r.choice([0.2, 0.6, 1.0, 1.7, 2.8]) for s, m in mass.items()}
    mean = sum(z * m for _, z, m in cells) / sum(mass.values())
    lam, mu = mixing.solve_dual(spark.createDataFrame(cells, "source string, level double, mass long"), targets, mean, 3.0)
    want_lam, want_mu = by_bisection(cells, targets, mean, 3.0)
    assert mu == pytest.approx(want_mu, abs=1e-5) and abs(mu) > 1e-3
    for s, z, _ in cells:
        rate, want = (min(3.0, math.exp(x[s] + m * (z - mean))) for x, m in ((lam, mu), (want_lam, want_mu)))
        assert rate == pytest.approx(want, abs=1e-4)


def test_targets_are_reshared():
    """By repeated resharing, as stated: what is above three times its source's size goes to the others by weight."""
    r = random.Random(3)
    for _ in range(200):
        sizes = {s: r.choice([0, 3, 10, 200, 5000]) for s in [*map(str, range(r.randrange(1, 9))), None]}
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
        want, free, rest = {}, set(sizes), sum(sizes.values())
        while free:
            share = rest / sum(weight[s] for s in free)
            full = {s for s in free if share * weight[s] > 3 * sizes[s]}
            if not full:
                want |= {s: share * weight[s] for s in free}
                break
            want |= {s: 3 * sizes[s] for s in full}
            rest, free = rest - sum(3 * sizes[s] for s in full), free - full
        got = mixing.targets_by_weight(sizes, (5, 2, 1), 3)
        assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s], abs=1e-6) for s in want)


def test_mix(spark):
    """Sources meet their targets, rates differ by length, repeated rows share copies, reruns on other partitions agree."""
    r = random.Random(1)
    text = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    shape = {"s0": (20, 60), "s1": (200, 30), "s2": (60, 40), None: (30, 20), "s3": (5, 3)}
    rows = [(0, text(0, max(1, int(r.lognormvariate(0, 0.8) * size))), s) for s, (size, n) in shape.items() for _ in range(n)]
    rows = [(i, t, s) for i, (_, t, s) in enumerate(rows)]
    rows += [(7, rows[7][1], rows[7][2]), (8, text(8, 50), "s0"), (900, None, "s1"), (901, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as lam", "3 as copies")
    got = mixing.mix(docs.repartition(3)).collect()
    key = lambda x: (x.doc_id, x.text_hash or 0, x.copies)
    assert [tuple(x) for x in sorted(got, key=key)] == [tuple(x) for x in sorted(mixing.mix(docs.repartition(5)).collect(), key=key)]
    assert len(got) == len(rows) and all(0 <= x.taken <= 3 * x.size for x in got)
    for s in shape:
        own = [x for x in got if x.source == s]
        assert abs(sum(x.taken for x in own) - own[0].target) <= max(x.size for x in own) / 2 + 1
        assert own[0].source_size == sum(x.size for x in own)
    assert len({(x.source, x.rate) for x in got if x.size}) > len(shape) + 10
    out = mixing.mixed(docs.repartition(3))
    assert out.columns == docs.columns and out.count() == sum(x.copies for x in got if x.text_hash is not None)
    assert mixing.mix(docs.limit(0)).count() == 0
