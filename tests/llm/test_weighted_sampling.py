"""Fingerprints against samples drawn in plain Python, and their collision rate against generalised Jaccard similarity."""

import hashlib
import math
import random
import re
from collections import Counter

import xxhash

from ledgerline.llm import weighted_sampling as ws

SCHEMA = "doc_id long, text string, id string, key string, side string"
UNSIGNED = 1 << 64


def signed(x):
    return x - UNSIGNED if x >> 63 else x




def hash_at(term, number):
    return xxhash.xxh64(int(term ^ (number * 0x9E3779B97F4A7C15 % (1 << 63))).to_bytes(8, "little", signed=True), seed=42).intdigest()


def samples(text, n):
    """(term, t) at each place, by the method's definition; None without terms."""
    weights = Counter(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    terms = {w: signed(xxhash.xxh64(w.encode(), seed=42).intdigest()) for w in weights}
    out = []
    for k in range(n):
        best = None
        for w, count in weights.items():
            one, two = hash_at(terms[w], 2 * k + 1), hash_at(terms[w], 2 * k + 2)
            unit = lambda h, shift, bits: (((h >> shift) & ((1 << bits) - 1)) + 0.5) / 2**bits
            r, c, b = -math.log(unit(one, 0, 21) * unit(one, 21, 21)), -math.log(unit(two, 0, 32) * unit(two, 32, 32)), unit(one, 42, 22)
            t = math.floor(math.log(count) / r + b)
            y = math.exp(r * (t - b))
            best = min(best or (math.inf,), (c / (y * math.exp(r)), w, t))
        out.append(best and best[1:])
    return out


def generalised(a, b):
    a, b = (Counter(re.findall(r"[^\x20\x09-\x0D]+", x or "")) for x in (a, b))
    words = a.keys() | b.keys()
    return sum(min(a[w], b[w]) for w in words) / sum(max(a[w], b[w]) for w in words) if words else 1.0


def texts():
    rng = random.Random(2)
    some = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "naïve", "x1", "the", "of", "zß"]) + ("" if rng.random() < 0.5 else str(rng.randint(0, 20))) for _ in range(n))
    same = some(60)
    rows = [(10, same), (3, some(80)), (7, None), (8, ""), (11, same), (12, " \t\n"), (20, some(3000)), (21, "lone"), (21, "lone"), (21, "other of the id"), (None, "no id"), (-5, "\U0001f600" * 9), (30, "a b")]
    return rows + [(100 + i, some(rng.randint(1, 40))) for i in range(40)]


def test_against_plain_python(spark):
    n = 16
    rows = texts()
    got = ws.fingerprints(spark.createDataFrame([(*r, "c", "l", "ash") for r in rows], SCHEMA).repartition(5), n).collect()
    assert len(got) == len(rows)
    lone = [r for r in got if r["doc_id"] == 21]
    assert len(lone) == 3 and sum(r == lone[0] for r in lone) + sum(r == lone[1] for r in lone) + sum(r == lone[2] for r in lone) == 5  # the rows alike
    # documents in order, those of one id in either order
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    tied = [i for i, r in enumerate(order) if r[0] == 21]
    swapped = order[:]
    swapped[tied[0]], swapped[tied[1]] = swapped[tied[1]], swapped[tied[0]]
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()

    def expected(order):
        out = {}
        for i, (d, t) in enumerate(order):
            nxt = order[(i + 1) % len(order)][1] or ""
            t = t or ""
            q = len(t) // 4
            out.setdefault(d, {})[digest(t[: len(t) - q] + nxt[:q])] = (t, t[: len(t) - q] + nxt[:q], nxt)
        return out

    ways = [expected(order), expected(swapped)]
    want = next(w for w in ways if all(r["edited_sha256"] in w[r["doc_id"]] for r in got))
    drawn = {}
    for r in got:
        t, e, nxt = want[r["doc_id"]][r["edited_sha256"]]
        assert r["n_chars"] == len(t) and len(r["fingerprint"]) == 8 * n
        a, b, c = (drawn.setdefault(x, samples(x, n)) for x in (t, e, nxt))
        assert r["near_edited"] == sum(x == y for x, y in zip(a, b)) / n
        assert r["near_next"] == sum(x == y for x, y in zip(a, c)) / n
        assert r["near_edited"] == sum(r["fingerprint"][i : i + 8] == r["edited_fingerprint"][i : i + 8] for i in range(0, 8 * n, 8)) / n
    prints = {}
    for r in got:
        prints.setdefault(want[r["doc_id"]][r["edited_sha256"]][0], set()).add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())
    assert prints[""] == prints[" \t\n"] == {"0" * 8 * n}


def test_collision_rate_is_generalised_jaccard(spark):
    """Pairs hold words of their own, so that errors are independent: 4 standard errors for each, 3 for their mean."""
    rng = random.Random(9)
    n, pairs = 128, 60
    rows = []
    for p in range(pairs):
        words = [f"p{p}w{i}" for i in range(60)]
        rows += [(2 * p + j, " ".join(w for w in words for _ in range(rng.randint(0, 5)))) for j in range(2)]
    got = {r["doc_id"]: r for r in ws.fingerprints(spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA), n).collect()}
    errors = []
    for p in range(pairs):
        like = generalised(rows[2 * p][1], rows[2 * p + 1][1])
        errors.append((got[2 * p]["near_next"] - like) / math.sqrt(like * (1 - like) / n))
    assert max(map(abs, errors)) < 4 and abs(sum(errors) / pairs) < 3 / math.sqrt(pairs)


def test_no_documents_and_one(spark):
    assert ws.fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0
    one = ws.fingerprints(spark.createDataFrame([(1, "abcdefgh", "", "", "")], SCHEMA)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0 and one[0]["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()


def test_main_path_is_native(spark):
    df = spark.createDataFrame([(1, "a b c", "", "", "")], SCHEMA)
    plan = ws.edited(df, ws.neighbours(df))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan.replace("Scan ExistingRDD", ""))


def test_terms_are_drawn_only_where_they_can_be_least(spark):
    """Whatever is left undrawn, at a usual reach or one so short that many places need a second look, no result changes."""
    df = spark.createDataFrame([(*r, "", "", "") for r in texts()], SCHEMA)
    rows = lambda reach: sorted(map(str, ws.fingerprints(df, 16, reach).collect()))
    assert rows(ws.REACH) == rows(1.0) == rows(1e9)
    # of single words, most are left undrawn
    ids = spark.range(20000).selectExpr("id % 10 AS g", "xxhash64(id) AS term", "1 AS weight", "12D / 1000 AS far")
    drawn = ids.selectExpr(f"count_if({ws.within(3)}) AS n").first()["n"]
    assert 0 < drawn < 3000
    every = ws.sampled(ids, ["g"], 4, False)
    assert every.where("greatest(p0, p1, p2, p3) < ln(0.012)").count() == 10 and ws.sampled(ids, ["g"], 4).exceptAll(every).count() == 0
