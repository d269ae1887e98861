"""The trie of conversation prefixes against a plain one."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tidewatch.llm import trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, int(c / 20) * 20
        rebuilt[c] = tuple(turns if c == base else own.get(base, [])[:h] + turns[h:])
    members, children = defaultdict(list), defaultdict(set)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].append(c)
            if d:
                children[rebuilt[c][: d - 1]].add(rebuilt[c][:d])
    words = {p: len(re.findall(r"[^\x20\x09-\x0d]+", p[-1][1])) if p else 0 for p in members}
    leaves, saved = Counter(), Counter()
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(members[p]) - 1) * words[p]
    out = Counter()
    for p, convs in members.items():
        ends = ",".join(str(c) for c in convs if len(rebuilt[c]) == len(p))
        parent = members[p[:-1]][0] if p else None
        out[(convs[0], len(p), parent, len(convs), len(children[p]) if p in children else 0, leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


def found(df, **options):
    out = trie.conversation_trie(df, **options)
    assert out.columns == COLUMNS
    return Counter(tuple(r) for r in out.collect())


def conversations(rng, n):
    rows = []
    for _ in range(n):
        conv = rng.choice([rng.randrange(-60, 200), rng.randrange(10**6)])
        for turn in range(rng.randint(1, 6)):
            rows.append((conv, rng.choice([turn, turn, None]), rng.choice(["user", "assistant", None, ""]), rng.choice(["hi there", "a b c", "", None, "x" * 50])))
    return rows


@pytest.mark.parametrize("limit", [4096, 3])
def test_trie_equals_a_plain_one(spark, limit):
    rows = conversations(random.Random(limit), 250)
    rows += [(None, 0, "user", "nobody's"), (40, None, None, None), (40, None, None, None), (41, 0, "user", "one")]
    rows += [(1000 + k, 0, "user", "the same first turn") for k in range(60)]
    rows += [(7777, k, "user", f"turn {k % 3}") for k in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    assert found(df, conversations=limit) == plain(rows)


def test_extra_columns_and_nothing(spark):
    rows = conversations(random.Random(1), 30)
    wide = [(*r, 1, "n", b"x", "p") for r in rows]
    df = spark.createDataFrame(wide, "conv_id long, turn int, role string, text string, pos long, node string, code binary, parent string")
    assert found(df) == plain(rows)
    assert trie.conversation_trie(df.where("false")).count() == 0


def test_turnless_conversations_are_members_of_the_root(spark):
    few = [c for c in range(1, 400) if c % 20 and zlib.crc32(str(c).encode()) % 4 >= 1][:5]
    rows = [(c, 0, "user", "gone") for c in few]
    got = found(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert got == plain(rows) and [r[:6] for r in got] == [(few[0], 0, None, 5, 0, 1)]


def test_role_and_text_are_told_apart(spark):
    rows = [(20, 0, "a", "bc"), (40, 0, "ab", "c"), (60, 0, "", "abc"), (80, 0, "abc", ""), (100, 0, None, "abc")]
    got = found(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert got == plain(rows) and sum(r[1] == 1 for r in got.elements()) == 4
