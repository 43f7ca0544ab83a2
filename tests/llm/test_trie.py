"""The trie of conversations against a walk over all of their prefixes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from lodestone.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, c string, d int, words string"


def brute(rows, step=20, shares=4):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            r, x = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), hashlib.md5(f"{r}\0{x}".encode()).hexdigest(), r, x))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    made = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % shares
        made[c] = tuple(own.get(c - c % step, [])[:h] + ts[h:])
    nodes = defaultdict(list)
    for c, ts in sorted(made.items()):
        for d in range(len(ts) + 1):
            nodes[ts[:d]].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for key in nodes:
        if key:
            kids[key[:-1]] += 1
    for key, members in nodes.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", key[-1][1])) if key else 0
        for d in range(len(key) + 1):
            saved[key[:d]] += (len(members) - 1) * words
            leaves[key[:d]] += key not in kids
    ends = defaultdict(list)
    for c, ts in sorted(made.items()):
        ends[ts].append(str(c))
    digest = lambda key: hashlib.sha256(",".join(ends[key]).encode()).hexdigest()
    return sorted(((m[0], len(k), nodes[k[:-1]][0] if k else None, len(m), kids[k], leaves[k], saved[k], digest(k)) for k, m in nodes.items()), key=repr)


def found(spark, rows, **args):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, trie.prefix_trie(*trie.rebuilt(df, args.get("step", 20), args.get("shares", 4))).collect()), key=repr)


def test_odd_conversations(spark):
    """Nulls in every column, ties, repeated rows, conversations of borrowed or of no turns, words between odd spaces."""
    rows = [(c, t, "u", f"t{t} a") for c in (0, 1, 2, 3, 20, 21, 41, 45) for t in range(4)]
    rows += [(5, None, None, "x y z"), (5, None, "a", None), (5, 1, "", ""), (5, 1, "", ""), (None, 1, "u", "gone"), (7, 1, None, None), (8, 1, "", ""), (63, 0, "u", "short"), (64, 0, "u", "t0 a")]
    assert found(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, seed):
    """Long common prefixes, many copies of one conversation, one conversation that holds most rows."""
    r = random.Random(seed)
    rows = [(c, t, r.choice("ua"), r.choice(["", "a", "a b", "c"])) for c in range(60) for t in range(r.randrange(1, 6))]
    rows += [(c, t, "u", f"same {t}") for c in range(100, 140) for t in range(3)]
    rows += [(77, t, "u", f"long {t % 3}") for t in range(300)] + [(97, t, "u", f"long {t % 3}") for t in range(250)]
    r.shuffle(rows)
    assert found(spark, rows) == brute(rows)


def test_query_equals_sql(spark, sf_dir):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    df = trie.op11_trie(spark, sf_dir)
    relation = c.sql(trie.SQL)
    assert relation.columns == df.columns
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(relation.fetchall(), key=repr)
