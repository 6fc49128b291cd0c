"""Conversation repair against brute force written from the contract."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from wordloom.llm import conversations as C
from wordloom.llm.queries import QUERIES

LEGAL = re.compile(r"(s?(ua)+)?")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        show = [" " if x is None else str(x) for x in (conv, turn)]
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(":".join(show).encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    """``rows``: (turn, role, text) of a conversation in order."""
    seen, out = set(), []
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, marks, longest=3):
    """Tries every edit sequence with up to ``longest`` inserts between two rows: (cost, audit, repaired rows)."""
    best = None
    fills = [list(f) for n in range(longest + 1) for f in itertools.product(("user", "assistant"), repeat=n)]

    def go(i, cost, audit, made):
        nonlocal best
        if best and cost > best[0]:
            return
        for fill in fills:
            c, a, m = cost + 2 * len(fill), audit + "I" * len(fill), made + [(r, "") for r in fill]
            if i == len(rows):
                if LEGAL.fullmatch("".join(r[:1] for r, _ in m)) and (best is None or (c, a) < best[:2]):
                    best = (c, a, m)
                continue
            _, role, text = rows[i]
            go(i + 1, c + 3, a + "D", m)
            if marks[i] not in ("blank", "duplicate"):
                more = marks[i] == "truncated"
                go(i + 1, c + more, a + "K", m + [(role, text)])
                for new in ("user", "assistant"):
                    go(i + 1, c + 2 + more, a + "R", m + [(new, text)])

    go(0, 0, "", [])
    return best


def dynamic(rows, marks):
    """The same by memoised recursion over (row, initials' state), for long conversations."""
    states = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    memo = {}
    for i in range(len(rows), -1, -1):
        for inserts in (0, 1, 2):
            for q in states:
                options = [(0, "", [])] if i == len(rows) and q in ("", "a") else []
                if i < len(rows):
                    _, role, text = rows[i]
                    c, a, m = memo[i + 1, q]
                    options.append((3 + c, "D" + a, m))
                    if marks[i] not in ("blank", "duplicate"):
                        more = marks[i] == "truncated"
                        for edit, own, price in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                            after = states[q].get(own[:1]) if own else q
                            if after is not None:
                                c, a, m = memo[i + 1, after]
                                options.append((price + more + c, edit + a, [(own, text), *m]))
                for own in ("user", "assistant"):
                    after = states[q].get(own[0])
                    if inserts and after and (i, after) in memo:
                        c, a, m = memo[i, after]
                        options.append((2 + c, "I" + a, [(own, ""), *m]))
                if options:
                    memo[i, q] = min(options)
    return memo[0, ""]


def expected(rows, damaged=True, solve=dynamic):
    held = {}
    for conv, *_ in rows:
        held[conv] = []
    for conv, turn, role, text in damage(rows) if damaged else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]:
        held[conv].append((turn, role, text))
    out = []
    for conv, own in held.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        marks, turns = faults(own), [r[0] for r in own if r[0] is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
        cost, audit, made = solve(own, marks)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, marks.count("blank"), marks.count("duplicate"),
                    marks.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", True, "z") for r in rows],
                                 "conv_id long, turn long, role string, text string, conv string, signature string, live boolean, h1 string")


def got(df):
    return sorted((tuple(r) for r in df.select("conv", *C.COUNTS, "audit", "repaired_sha256").collect()), key=str)


def some(seed, convs, most):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", " \t\n", "", "Ends. \n", "x", None, "Same.", "a.b"]
    return [(c, t, r.choice(["user"] * 4 + ["assistant"] * 4 + ["system", "tool", "uncle", None, ""]), r.choice(texts) if r.random() < 0.4 else f"Text {r.random()}.")
            for c in range(convs) for t in sorted(r.sample(range(most * 2), r.randint(1, most)))]


MESSY = ([(None, None, "user", "One."), (None, None, "assistant", "Two."), (None, 1, None, None), (1, None, "user", None), (1, None, "user", "A."),
          (2, 5, "assistant", "Only."), (3, 2, "system", "Rules."), (4, 1, "user", ""), (5, -3, "user", "Gap."), (5, 9, "assistant", "Gap!"), (6, 1, "user", "Q?"),
          (6, 1, "user", "Q?"), (6, 1, "assistant", "R"), (7, 1, "", "No role."), (7, 2, "", "No role too")] + some(1, 60, 8))


def test_automaton_equals_every_edit_sequence():
    for seed in range(25):
        own = [(t, r or " ", x or " ") for _, t, r, x in some(seed, 1, 4) if r != ""]
        marks = faults(own)
        assert dynamic(own, marks) == cheapest(own, marks)


@pytest.mark.parametrize("damaged", [True, False])
def test_matches_brute_force(spark, damaged):
    found = C.report(C.rows_of(table(spark, MESSY).repartition(3), damaged=damaged))
    assert got(found) == expected(MESSY, damaged)


def test_long_conversation(spark):
    r = random.Random(3)
    rows = [(1, t, r.choice(["user", "assistant"]), r.choice(["Cut", "Done.", f"{t}."])) for t in range(800)] + [(2, t, "user", "again " * 5_000 + ".") for t in range(3)]
    assert got(C.report(C.rows_of(table(spark, rows)))) == expected(rows, False)


def test_repaired_rows(spark):
    found = C.repair(C.rows_of(table(spark, MESSY))).collect()
    by_conv = {}
    for r in sorted(found, key=lambda r: r["place"]):
        by_conv.setdefault(r["conv"], []).append(f"{r['role']}:{r['text']}")
    for conv, *_, digest in expected(MESSY, False):
        assert hashlib.sha256("\n".join(by_conv.get(conv, [])).encode()).hexdigest() == digest


def test_nodes_are_made_once_per_suffix(spark, monkeypatch):
    made = []
    init = C.Node.__init__
    monkeypatch.setattr(C.Node, "__init__", lambda self, symbol, rest: (made.append(symbol), init(self, symbol, rest))[1])
    table_ = sorted({"uaua"[i:] for i in range(4)} | {"xuaua", "sua", ""}, key=lambda s: s[::-1])
    path, last = [C.END], ""
    for s in table_:
        b = s[::-1]
        same = next((i for i, (x, y) in enumerate(zip(b, last)) if x != y), min(len(b), len(last)))
        del path[same + 1:]
        for symbol in b[same:]:
            path.append(C.Node(symbol, path[-1]))
        last = b
    assert len(made) == len({s[i:] for s in table_ for i in range(len(s))})


def test_empty_table(spark):
    assert C.report(C.rows_of(table(spark, []), damaged=True)).collect() == []


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    found = QUERIES["op12_conversation_repair"](spark, sf).withColumnRenamed("conv_id", "conv")
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(found) == expected(rows)
