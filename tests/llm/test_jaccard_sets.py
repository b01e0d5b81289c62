"""Links are of sets of shingles: how often a text repeats them changes nothing, and links at the threshold itself are found."""

import random

from corvidex.llm import jaccard_join

from .cases import frame, words


def _links(spark, rows):
    return {r.doc_id: (r.n_links, r.group_id) for r in jaccard_join.jaccard_join(frame(spark, rows)).collect()}


def test_texts_that_repeat_their_shingles_link_with_those_that_do_not(spark):
    rows = []
    for i in range(12):
        base = words(100 + i, 90)
        changed = base.split()
        changed[45] = "changed"
        rows += [(3 * i, base), (3 * i + 1, " ".join([base] * 5)), (3 * i + 2, " ".join([*changed, *changed]))]
    assert _links(spark, rows) == {d: (2, d - d % 3) for d, _ in rows}


def test_links_at_the_threshold_are_not_lost(spark):
    r = random.Random(3)
    rows = []
    for i in range(4000):
        w = [f"w{r.randrange(10**9)}" for _ in range(9)]
        rows += [(2 * i, " ".join(w[:8])), (2 * i + 1, " ".join(w))]  # four of five shingles
    assert _links(spark, rows) == {d: (1, d - d % 2) for d, _ in rows}
