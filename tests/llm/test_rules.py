"""Host verdicts of the quality rules, against a plain computation."""

import math
import random

import pytest

from hornfels.llm import quality_rules as Q

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def text_of(rng, kind):
    words = rng.sample(WORDS, 14)
    if kind == "short":
        return " ".join(words[:5])
    if kind == "repeats":
        return " ".join(words[:6] * 4)
    if kind == "symbols":
        return " ".join(f"#{w}$$" for w in words)
    if kind == "lines":
        return "\n".join([" ".join(words), "a", "a", "b", "b", "c", "c"])  # repeated lines, but no window of five words twice
    return " ".join(words)


def failed(t):
    w = (t or "").split()
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)}
    lines = [x for x in (t or "").split("\n") if x.split()]
    symbols = sum((t or "").count(c) for c in Q.SYMBOLS)
    return {
        "short": len(w) < 10, "repeats": 100 * len(covered) > 20 * len(w), "symbols": 100 * symbols > 10 * sum(map(len, w)), "lines": 100 * (len(lines) - len(set(lines))) > 30 * len(lines),
    }


def shares(t):
    """Per cent of symbols and of repeated lines."""
    lines = [x for x in (t or "").split("\n") if x.split()]
    return {
        "symbols": 100 * sum((t or "").count(c) for c in Q.SYMBOLS) / max(1, sum(map(len, (t or "").split()))),
        "lines": 100 * (len(lines) - len(set(lines))) / max(1, len(lines)),
    }


def expected(rows):
    """(doc_id, kept), the hosts that are bad on a rule, and their limits on the soft ones, by loops."""
    hosts = {h: [failed(t) for _, t, s in rows if s == h] for h in {s for _, _, s in rows}}
    total = len(rows)
    bad, limit = set(), {}
    for r in Q.RULES:
        k = {h: sum(f[r] for f in fs) for h, fs in hosts.items()}
        mean = sum(k.values()) / total
        spread = max(sum(len(hosts[h]) * (k[h] / len(hosts[h])) ** 2 for h in hosts) / total - mean**2 - mean * (1 - mean) * len(hosts) / total, 1e-6)
        strength = min(max(mean * (1 - mean) / spread - 1, 1.0), 1e4)
        a, b = max(mean, 1e-6) * strength, max(1 - mean, 1e-6) * strength
        for h in hosts:
            n = len(hosts[h]) + a + b
            rate = (k[h] + a) / n
            margin = Q.SURE * math.sqrt(rate * (1 - rate) / (n + 1))
            if rate - margin > Q.WORSE * a / (a + b):
                bad.add((h, r))
            limit[h, r] = min(max(a / (a + b) / rate, 1 / Q.LENIENT), Q.LENIENT) * {"symbols": 10, "lines": 30}.get(r, 0)
    kept = {}
    for i, t, h in rows:
        f = failed(t)
        kept[i] = not (f["short"] or f["repeats"]) and not any(x == h for x, _ in bad) and all(shares(t)[r] <= limit[h, r] for r in Q.SOFT)
    return kept, bad, limit


def corpus():
    """A host bad on each rule, one with few failures, one of two documents (both bad), ordinary ones, and none."""
    rng = random.Random(3)
    rows = []
    for r in Q.RULES:
        rows += [(f"bad-{r}", r if k % 10 < 8 else "") for k in range(120)]
    rows += [("tiny", "repeats")] * 2 + [("tiny", "")] * 2
    rows += [("clean", "lines" if k < 2 else "") for k in range(900)]
    for h in [None, "h1", "h2", "h3", "h4", "h5", "h6"]:
        rows += [(h, str(rng.choice(["symbols", "lines", "repeats", "short", *[""] * 26]))) for _ in range(300)]
    rng.shuffle(rows)
    return [(k, text_of(rng, kind), h) for k, (h, kind) in enumerate(rows)]


def test_verdicts_are_those_of_a_loop(spark):
    rows = corpus()
    kept, bad, limit = expected(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = {r.doc_id: r for r in Q.apply_rules(docs).collect()}
    assert {i: r.kept for i, r in got.items()} == kept
    assert {h for h, _ in bad} == {f"bad-{r}" for r in Q.RULES}  # and not the tiny one, which the prior saves
    assert limit["clean", "lines"] > 50 > 30 > limit["h1", "lines"]
    by_host = {h: [i for i, _, s in rows if s == h] for h in ("bad-symbols", "tiny", "clean")}
    assert not any(got[i].kept for i in by_host["bad-symbols"])
    assert any(got[i].kept for i in by_host["tiny"])
    # the same text stays at a host that rarely repeats lines and goes at one that often does
    saved, lost = ([i for i, t, s in rows if s == h and failed(t)["lines"]] for h in ("clean", "h1"))
    assert len(saved) == 2 and all(got[i].kept for i in saved)
    assert lost and not any(got[i].kept for i in lost)
    assert [i for i, t, s in rows if s == "h1" and failed(t)["symbols"] and got[i].kept] == []


@pytest.mark.parametrize("hosts", [1, 5])
def test_equal_rates_reject_no_host(spark, hosts):
    rng = random.Random(1)
    rows = [(k, text_of(rng, "repeats" if k // hosts % 10 == 0 else ""), f"h{k % hosts}") for k in range(500)]
    out = Q.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert out.where("not host_ok").count() == 0 and out.where("kept").count() == 450
