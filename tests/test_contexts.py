"""Contexts against dropping one block after the other and measuring what is left each time."""

import random

import pytest

from lodeworks.operators import contexts

PHASES = ["claim", "snippet", "candidate"]


def by_hand(blocks, needs, budget, constant):
    left = {p: sorted(b for b in blocks if b[0] == p) for p in PHASES}

    def total():
        kept = {b[2] for own in left.values() for b in own}
        pieces = {(p, t) for i, p, t in needs if i in kept}
        return constant + sum(len(b[3]) + 1 for own in left.values() for b in own) + sum(len(t) + 1 for _, t in pieces)

    while total() > budget * contexts.TOKEN and any(len(own) > 1 for own in left.values()):
        for phase in reversed(PHASES):
            if len(left[phase]) > 1:
                left[phase].pop()
                break
    kept = {b[2] for own in left.values() for b in own}
    return kept, {p for i, p, _ in needs if i in kept}, total(), total() <= budget * contexts.TOKEN


@pytest.mark.parametrize("budget", [20, 60, 100, 100_000])
def test_trimming_equals_dropping_from_the_end(spark, budget):
    r = random.Random(budget)
    blocks, needs, want = [], [], {}
    for task in range(25):
        own = [(p, k, f"{p}{k}", "x" * r.randint(1, 40)) for p in PHASES for k in range(r.randint(0, 7))]
        pieces = {f"E{k}": "y" * r.randint(1, 30) for k in range(6)}
        refers = [(b[2], e, pieces[e]) for b in own for e in r.sample(sorted(pieces), r.randint(0, 3))]
        blocks += [(task, *b) for b in own]
        needs += [(task, *n) for n in refers]
        if own:
            want[task] = by_hand(own, refers, budget, 11)
    needs_df = spark.createDataFrame(needs, "task_id int, id string, piece string, text string")
    done = contexts.trimmed(spark.createDataFrame(blocks, "task_id int, phase string, place int, id string, text string"), needs_df, PHASES, budget, 11)
    rows, found = done.collect(), {}
    for x in rows:
        found.setdefault(x.task_id, [set(), set(), x.chars, x.fits])[0].update([x.id] if x.kept else [])
    for x in contexts.pieces_left(done, needs_df).collect():
        found[x.task_id][1].add(x.piece)
    assert {k: tuple(v) for k, v in found.items()} == want and len(rows) == len(blocks)


def test_claims_evidence_and_rendering(spark, rows):
    cards = spark.createDataFrame([(1, "k2", 0), (1, "k1", 1), (2, "k1", 0)], "task_id int, card string, place int")
    claims = spark.createDataFrame([("k1", "a", "one", "verified", ["x", "y"], 0), ("k1", "b", "guess", "inferred", ["z"], 1), ("k2", "a", "two", "verified", ["y"], 0)], "card string, claim string, text string, status string, evidence array<string>, place int")
    usable, out = contexts.claims_of(cards, claims)
    assert rows(usable.select("task_id", "id", "place")) == [(1, "k1/a", 2), (1, "k2/a", 1), (2, "k1/a", 1)] and rows(out) == [(1, "k1", "b", "inferred filtered"), (2, "k1", "b", "inferred filtered")]
    assert rows(contexts.numbered_evidence(usable)) == [(1, "x", 2), (1, "y", 1), (2, "x", 1), (2, "y", 2)]
    blocks = spark.createDataFrame([(1, "claim", 1, "k2/a", "- two"), (1, "claim", 2, "k1/a", "- one"), (1, "candidate", 1, "s", "- symbol")], "task_id int, phase string, place int, id string, text string")
    needs = spark.createDataFrame([(1, "k2/a", "E1", "- [E1] y"), (1, "k1/a", "E1", "- [E1] y"), (1, "k1/a", "E2", "- [E2] x")], "task_id int, id string, piece string, text string")
    head = spark.createDataFrame([(1, "# Task")], "task_id int, text string")
    for budget, want in ((1000, "# Task\n\n## Claims\n\n- two\n- one\n\n## API\n\n- symbol\n\n## Evidence\n\n- [E1] y\n- [E2] x"), (7, "# Task\n\n## Claims\n\n- two\n\n## API\n\n- symbol\n\n## Evidence\n\n- [E1] y")):
        done = contexts.trimmed(blocks, needs, PHASES, budget)
        got = contexts.rendered(done, contexts.pieces_left(done, needs), head, {"claim": "Claims", "candidate": "API"}, "Evidence").first()
        assert got.markdown == want and got.tokens == -(-len(want) // 4) and got.fits
    picked = contexts.chosen(spark.createDataFrame([(1, t, i, s, True) for t, i, s in (("symbol", "a", 5), ("symbol", "b", 9), ("component", "c", 1), ("card", "d", 99))] + [(1, "symbol", "e", 50, False)], "task_id int, type string, id string, score long, selected boolean"), {"symbol": 1})
    assert [(x.id, x.place) for x in picked.orderBy("place").collect()] == [("c", 1), ("b", 2), ("d", 3)]
