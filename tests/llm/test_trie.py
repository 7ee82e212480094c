import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from stockline.llm import conversation_trie, tree_contraction


def plain_trie(rows):
    """{(conv_id, depth): (parent, n_convs, n_children, n_leaves, saved, sha)} by walking dictionaries."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            convs[conv].append((turn is not None, turn or 0, digest, role, text))
    convs = {c: [t[3:] for t in sorted(ts)] for c, ts in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(convs):
        h = zlib.crc32(str(c).encode()) % 9
        seq = tuple(convs.get(c - c % 5, [])[:h] + convs[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    children = defaultdict(list)
    for s in members:
        if s:
            children[s[:-1]].append(s)
    totals = {}
    for s in sorted(members, key=len, reverse=True):
        leaves = sum(totals[k][0] for k in children[s]) if children[s] else 1
        own = (len(members[s]) - 1) * len(s[-1][1].encode()) if s else 0
        totals[s] = (leaves, own + sum(totals[k][1] for k in children[s]))
    return {(min(m), len(s)): (min(members[s[:-1]]) if s else None, len(m), len(children[s]), *totals[s],
                               hashlib.sha256(",".join(map(str, sorted(ends[s]))).encode()).hexdigest()) for s, m in members.items()}


def result(df):
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()}


@pytest.fixture(scope="module")
def talks():
    """Shared first turns, copies, one long conversation, repeated rows, ties, nulls, lonely members of a group."""
    rnd = random.Random(8)
    rows = []
    for c in range(0, 9_000, 150):
        for c in range(c, c + rnd.randint(0, 5)):
            for t in range(rnd.randint(1, 7)):
                rows.append((c, t, rnd.choice(["user", "assistant", None]), rnd.choice(["a", "é", "", None, "bb"]) if t else "hello"))
    rows += [(20_000, t, "user", f"turn {t % 3}") for t in range(150)]
    rows += [(c, t, "user", "same") for c in range(30_000, 30_040, 2) for t in range(4)]
    rows += [(40_000, None, "user", "null turn"), (40_000, 1, "user", "x"), (40_000, 1, "user", "x"), (40_000, 1, "user", "w"), (None, 1, "user", "nobody")]
    rnd.shuffle(rows)
    return rows


def test_trie_equals_a_walk_over_dictionaries(spark, talks):
    table = spark.createDataFrame([(*r, "x", 1, 2) for r in talks], "conv_id long, turn long, role string, text string, id string, depth int, k1 int").repartition(3)
    rows = conversation_trie.trie(table)
    assert result(rows) == plain_trie(talks)
    assert rows.count() == len(plain_trie(talks))


def test_trie_of_nothing_is_nothing(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert conversation_trie.trie(spark.createDataFrame([], schema)).collect() == []
    assert conversation_trie.trie(spark.createDataFrame([(None, 1, "user", "x")], schema)).collect() == []


def test_conversations_without_turns_are_members_of_the_root(spark):
    """A conversation whose head replaces all of its turns and whose group has no first."""
    conv = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1)
    rows = [(conv, 0, "user", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert result(conversation_trie.trie(table)) == plain_trie(rows) == {
        (conv, 0): (None, 1, 0, 1, 0, hashlib.sha256(str(conv).encode()).hexdigest())}


def test_contraction_gives_every_subtree_total(spark):
    rnd, n = random.Random(3), 130
    shapes = [
        [None] + [rnd.randrange(max(0, i - 9), i) for i in range(1, n)],                # random
        [None] + list(range(n - 1)),                                                    # one chain
        [None] + [0] * (n - 1),                                                         # a star
        [None] + [i - 1 if i % 2 else max(0, i - 2) for i in range(1, n)],              # a comb
        [None if i % 10 == 0 else i - rnd.randint(1, i % 10) for i in range(n)],        # small trees
    ]
    parent = [None if p is None else p + n * k for k, shape in enumerate(shapes) for p in shape]
    total = {i: (1, i) for i in range(len(parent))}
    for i in reversed(range(len(parent))):
        if parent[i] is not None:
            total[parent[i]] = tuple(a + b for a, b in zip(total[parent[i]], total[i]))
    nodes = spark.createDataFrame([(i, p, 1, i) for i, p in enumerate(parent)], "id long, parent long, one long, own long")
    got = {r.id: (r.one, r.own) for r in tree_contraction.subtree_totals(nodes, ["one", "own"]).collect()}
    assert got == total


def test_contraction_names_a_cycle(spark):
    nodes = spark.createDataFrame([(1, 2, 1), (2, 1, 1)], "id long, parent long, v long")
    with pytest.raises(ValueError, match="cycle"):
        tree_contraction.subtree_totals(nodes, ["v"])
