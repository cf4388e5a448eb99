"""Conversation repair against an enumeration of all edits, on made conversations with nulls, ties, copies and long ones."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from ledgerline.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string, cost string"
WHOLE = re.compile(r"(s?(ua)+)?\Z")


def cheapest(turns):
    """(cost, audit, lines) over all edits of a few turns (role, text, must_go, truncated), up to two inserts at a time."""
    inserts = ["", "u", "a", "ua", "au"]
    choices = []
    for role, text, must_go, truncated in turns:
        some = [(4, "D", None)]
        if not must_go:
            more = 3 if truncated else 0
            some += [(more, "K", (role, text))] + [(3 + more, "R", (to, text)) for to in ("user", "assistant")]
        choices.append(some)
    best = None
    for gaps in itertools.product(inserts, repeat=len(turns) + 1):
        for edits in itertools.product(*choices):
            cost, audit, lines = 0, "", []
            for i, gap in enumerate(gaps):
                cost, audit = cost + 3 * len(gap), audit + "I" * len(gap)
                lines += [({"u": "user", "a": "assistant"}[g], "") for g in gap]
                if i < len(edits):
                    cost, audit = cost + edits[i][0], audit + edits[i][1]
                    lines += [edits[i][2]] if edits[i][2] else []
            if (best is None or (cost, audit) < best[:2]) and WHOLE.match("".join(r[:1] or "-" for r, _ in lines)):
                best = (cost, audit, [f"{r}:{t}" for r, t in lines])
    return best


def test_product_is_the_cheapest_edit():
    rng = random.Random(3)
    for _ in range(60):
        turns = [(rng.choice(["system", "user", "assistant", "tool", ""]), f"t{i}", rng.random() < 0.2, rng.random() < 0.2) for i in range(rng.randint(1, 4))]
        product = None
        for role, _, must_go, truncated in turns:
            m = cv.turn_matrix(role[:1], must_go, truncated)
            product = m if product is None else cv.times(product, m)
        cost, audit = cv.answer(product)
        want = cheapest(turns)
        assert (cost, audit) == want[:2]
        assert list(cv.repaired(audit, iter([t[:2] for t in turns]))) == want[2]


def test_product_is_associative():
    rng = random.Random(5)
    for _ in range(50):
        x, y, z = (cv.turn_matrix(rng.choice("suax"), rng.random() < 0.3, rng.random() < 0.3) for _ in range(3))
        assert cv.times(cv.times(x, y), z) == cv.times(x, cv.times(y, z))


def damage(rows):
    out = []
    for conv, turn, role, text, _ in rows:
        sp = lambda x: " " if x is None else x
        kind = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
        role, text = sp(role), sp(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text, c) for c in range(2 if kind == 3 else 1)]
    return out


def expect(rows):
    want = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in damage(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode(), r[4]))
        seen, kinds, known = set(), [], [t[1] for t in turns if t[1] is not None]
        for _, _, role, text, _ in turns:
            word = re.sub(r"[\x20\x09-\x0D]", "", text)
            kinds.append("blank" if not word else "duplicate" if (role, text) in seen else "truncated" if word[-1] not in ".!?" else "")
            seen.add((role, text))
        # a forward search over states, in place of matrices
        best = {0: (0, "", ())}
        step = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}

        def inserted(now):
            for _ in range(3):
                for i, (c, a, ls) in list(now.items()):
                    for r, name in (("u", "user"), ("a", "assistant")):
                        if i in step[r] and (c + 3, a + "I") < now.get(step[r][i], (1e9,))[:2]:
                            now[step[r][i]] = (c + 3, a + "I", (*ls, f"{name}:"))
            return now

        for (_, _, role, text, _), k in zip(turns, kinds):
            best, new = inserted(best), {}
            for i, (c, a, ls) in best.items():
                ways = [(i, c + 4, a + "D", ls)]
                if k not in ("blank", "duplicate"):
                    c += 3 * (k == "truncated")
                    ways += [(step[role[:1]][i], c, a + "K", (*ls, f"{role}:{text}"))] if i in step.get(role[:1], {}) else []
                    ways += [(step[r][i], c + 3, a + "R", (*ls, f"{name}:{text}")) for r, name in (("u", "user"), ("a", "assistant")) if i in step[r]]
                for j, *w in ways:
                    new[j] = min(new.get(j, (1e9,)), tuple(w))
            best = new
        cost, audit, lines = min(v for k, v in inserted(best).items() if k in (0, 3))
        initials = [t[2][:1] for t in turns]
        want[conv] = (
            max(known) - min(known) + 1 - len(set(known)) if known else 0, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return want


def check(spark, rows):
    got = cv.repair(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want = expect(rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r["conv_id"]], r["conv_id"]


def test_conversations_of_all_kinds(spark, monkeypatch):
    monkeypatch.setattr(cv, "RUN", 8)
    monkeypatch.setattr(cv, "FAN", 3)
    rng = random.Random(11)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.choice([1, 2, 3, 6, 9])):
            role = rng.choice(["system", "user", "assistant", "assistant", "user", "tool", None, "", "\nodd"])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 2]), role, rng.choice(["Hello.", "Why?", "no end", "", " \t", None, "naïve é!", "x" * 5000 + "."]), "clash"))
    rows += [(777, t, "user" if t % 2 else "assistant", f"turn {t % 40}.", "") for t in range(700)]
    rows += [(888, 5, "user", "same.", "")] * 90 + [(889, 1, None, None, None)]
    rows += [(conv, 0, "user", "gone.", "") for conv in range(1000, 1040)]  # some have no row left
    check(spark, rows)


def test_no_conversations(spark):
    assert cv.repair(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("audit,lines", [("", []), ("KKI", ["system:x", "user:y", "assistant:"]), ("DRK", ["user:y", "assistant:z"])])
def test_repaired(audit, lines):
    turns = [("system", "x"), ("user" if audit != "DRK" else "tool", "y"), ("assistant", "z")]
    assert list(cv.repaired(audit, iter(turns))) == lines
