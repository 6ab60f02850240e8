"""The SQL of op5, op6 and op7 against plain Python on sf0.001 and awkward rows."""

import hashlib
import re

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from palimpsest.llm import chat, sql
from palimpsest.llm.jaccard import shingle_set
from palimpsest.llm.rules import BASE, RULES, Document

AWKWARD = [None, "", " \n\t", "one", "Two words", "two WORDS", "A B c a b C", "é É\x85x  y", "a b c " * 40, "<<# 1\n\n1\n 1\n1 " * 30, "AB CD É EF " * 25]


@pytest.fixture(scope="module")
def rows():
    real = pq.read_table("/root/testdata/sf0.001/documents.parquet").select(["doc_id", "text"]).to_pylist()
    return [(r["doc_id"], r["text"]) for r in real] + [(10**9 + k, t) for k, t in enumerate(AWKWARD)]


@pytest.fixture(scope="module")
def db(rows):
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}))
    return con


def test_op7_sql(db, rows):
    def features(d):
        return d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, any(r.rejects(d) for r in BASE), not any(r.rejects(d) for r in RULES)

    expected = sorted((k, *features(Document(t))) for k, t in rows)
    assert sorted(db.execute(sql.OP7).fetchall()) == expected


def test_op6_sql(db, rows):
    sets = {k: set(shingle_set(t, 3).tolist()) for k, t in rows}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if 100 * min(len(sets[a]), len(sets[b])) < 90 * max(len(sets[a]), len(sets[b])) or not sets[a]:
                continue
            both = len(sets[a] & sets[b])
            if 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    assert sorted(db.execute(sql.OP6).fetchall()) == [(k, len(sets[k]), find(k)) for k in ids]


def test_op5_sql():
    texts = [None, "", "plain", "a < b [c]", "</s>", "[INST] x", "back\\\\slash", "\\l", "\\b", "\\x", "<<SYS>>", "é\n\n"]
    turns = [(1, k, ("user", "assistant", "system", "tool", None, "[ROLE]")[k % 6], t) for k, t in enumerate(texts)] + [(2, 0, "user", None), (3, 5, "assistant", "b"), (3, 4, "assistant", "a")]
    con = duckdb.connect()
    con.register("conversations", pa.table({c: list(v) for c, v in zip(("conv_id", "turn", "role", "text"), zip(*turns))}))
    extra = [(-7, k, r, "</s>[INST] ok [/INST]") for k, r in enumerate(("user", "assistant"))]

    def formatted(role, text):
        hard = re.search(chat.MARK_PATTERN + r"|\\\\|\\l|\\b", role + "\n" + text)
        out = [x.replace("\\", "\\\\").replace("<", "\\l").replace("[", "\\b") if hard else x for x in (role, text)]
        if role in chat.MARKS:
            return out[1].join(chat.MARKS[role])
        return chat.NAMED[0] + out[0] + chat.NAMED[1] + out[1] + chat.NAMED[2]

    expected = []
    for conv in (-7, 1, 2, 3):
        own = [(r or "", t or "") for c, _, r, t in sorted(extra + turns, key=lambda x: x[:2]) if c == conv]
        said = "".join(t for r, t in own if r == "assistant")
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{r}\n{t}\n" for r, t in own), said)]
        expected.append((conv, len(own), digest[0], len(said), digest[1], sum(len(formatted(r, t)) for r, t in own)))
    assert sorted(con.execute(sql.OP5).fetchall()) == expected
