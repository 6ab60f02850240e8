"""Every query against a plain re-computation in one process."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest

from palimpsest.llm import queries

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="session")
def result(spark, folder):
    kept = {}

    def get(name: str) -> pd.DataFrame:
        if name not in kept:
            kept[name] = queries.queries()[name](spark, folder).toPandas()
        return kept[name]

    return get


def crc(ids) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


@pytest.fixture(scope="session")
def word_ids(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = docs.text.fillna("").tolist()
    return dict(zip(docs.doc_id.tolist(), [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]))


def test_op1_token_files(result, word_ids):
    got = result("op1_token_files").set_index("doc_id")
    start = 0
    assert sorted(got.index) == sorted(word_ids)
    for doc_id in sorted(word_ids):
        ids = word_ids[doc_id] + [1]
        row = got.loc[doc_id]
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), crc(ids)), doc_id
        start += len(ids)


def test_words_with_awkward_ends():
    import random

    from palimpsest.llm.tokens import WordEncoder

    encoder = WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    units = ["a", "Z", "é", "É", "e\u0301", "İ", "Σ", "ß", "\u0958", "\ufb1d", "가", "\u1100\u1161", "1", "½", "ª", ".", ",", "!", "(", ")", "<|endoftext|>", "<|ENDOFTEXT|>", "<", "|", ">", "'s", "'", "’", "#", "*", " ", "\u00a0", "\n", "\t", "\0", "\u0338", "😀", "~", "^", "_", "the", "Word"]
    draw = random.Random(7)
    texts = ["".join(draw.choices(units, k=draw.randint(0, 60))) for _ in range(3000)] + [None, "", " "]
    got = [row.tolist() for at in range(0, len(texts), 100) for row in encoder.encode(texts[at : at + 100], 2)]
    assert got == [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def test_op2_byte_bpe(result, docs):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = result("op2_byte_bpe").set_index("doc_id")
    for doc_id, text in zip(docs.doc_id, docs.text.astype(object).where(docs.text.notna(), "")):
        ids = known.encode_ordinary(text)
        row = got.loc[doc_id]
        assert row.n_tokens == len(ids), doc_id
        assert row.ids_sha256 == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), doc_id
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest(), doc_id


def test_op3_packing(result, word_ids):
    got = result("op3_packing")
    assert set(got.doc_id) == set(word_ids)
    for doc_id, rows in got.sort_values("start").groupby("doc_id"):
        ids, at = word_ids[doc_id] + [2], 0
        for row in rows.itertuples():
            assert row.start == at and row.doc_tokens == len(ids)
            assert row.ids_crc32 == crc(ids[at : at + row.length])
            at += row.length
        assert at == len(ids)
    used = 0
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        assert rows.offset.tolist() == (rows.length.cumsum() - rows.length).tolist()
        assert rows.length.sum() <= 4096
        used += 1
    total = got.length.sum()
    assert used <= -(-total // 4096) * 1.05 + 3


def test_op4_quality_is_interpolated_modified_kneser_ney(spark):
    from palimpsest.llm import kneser_ney

    trusted = ["abracadabra abba", "the cat sat on the mat", "a cab, a bat"] * 2 + ["banana bandana"]
    others = ["abba sat", "zzzz qqqq", "the bat", ""]
    rows = [(k, "en", t) for k, t in enumerate(trusted + others)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    ids = spark.createDataFrame([(k,) for k in range(len(trusted))], "doc_id long")
    got = {r["doc_id"]: r for r in kneser_ney.classify(docs, ids).collect()}

    order, start = 4, ""
    grams = lambda t: [((start * 3 + t)[k : k + 4]) for k in range(len(t))]
    counts = {4: Counter(g for t in trusted for g in grams(t))}
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cuts, contexts = {}, {}
    for k in range(1, order + 1):
        n = [sum(c == j for c in counts[k].values()) for j in range(5)]
        y = n[1] / max(n[1] + 2 * n[2], 1)
        d = []
        for j in (1, 2, 3):
            value = j - (j + 1) * y * n[j + 1] / max(n[j], 1) if j < 4 and n[j] else 0
            d.append(value if n[j] and 0 < value <= j else j / 2)
        cuts[k] = lambda c, d=d: min(d[min(c, 3) - 1], c)
        contexts[k] = defaultdict(lambda: [0, 0.0, 0])
        for g, c in counts[k].items():
            entry = contexts[k][g[:-1]]
            entry[0] += c
            entry[1] += cuts[k](c)
            entry[2] += 1

    def p(g: str) -> float:
        k = len(g)
        if k == 0:
            raise AssertionError
        total, spare, types = contexts[k].get(g[:-1], (0, 0, 0))
        low = 1 / (contexts[1][""][2] + 1) if k == 1 else p(g[1:])
        if not total:
            return low
        c = counts[k].get(g, 0)
        return (c - cuts[k](c) if c else 0) / total + spare / total * low

    for k, text in enumerate(trusted + others):
        if text:
            expected = float(np.exp(-np.mean([np.log(p(g)) for g in grams(text)])))
            assert got[k]["perplexity"] == pytest.approx(expected, rel=1e-4), text
    assert not got[len(trusted) + 3]["kept"] and got[0]["kept"]
    assert not got[len(trusted) + 1]["kept"]


def sample_by_language(source: str) -> pd.DataFrame:
    """Distinct clean documents of 50 words or more of sf0.1."""
    rows = pd.read_parquet("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text", "lang"]).merge(pd.read_parquet("/root/testdata/sf0.1/labels.parquet"), on="doc_id")
    rows = rows[(rows.quality == 1) & (rows.toxic.fillna(0) == 0) & (rows.text.str.split().str.len() >= 50)]
    return rows[rows.lang == source].drop_duplicates("text").sort_values("doc_id")


def test_op4_quality_few_trusted_documents(spark):
    """The share of clean documents kept does not hang on how many trusted ones a language has."""
    from palimpsest.llm import kneser_ney

    english = sample_by_language("en")[:400]
    rows, ids, others = [(int(i), "en", t) for i, t in zip(english.doc_id, english.text)], [int(i) for i in english.doc_id], {}
    for base, source in ((10**7, "es"), (2 * 10**7, "fr")):
        texts = sample_by_language(source).text.tolist()
        for n in (3, 5, 10):
            # the same language under another name for each number of trusted documents
            name, first = f"{source}{n}", base + 1000 * n
            chosen = texts[n * 7 : n * 8] + texts[150:270]
            rows += [(first + k, name, t) for k, t in enumerate(chosen)] + [(first + 900, name, "# * $ % & | < > " * 40)]
            ids += range(first, first + n)
            others[name] = n
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = kneser_ney.classify(docs, spark.createDataFrame([(i,) for i in ids], "doc_id long")).toPandas()
    place = got.doc_id % 1000
    for name, n in others.items():
        own = got[got.lang == name]
        clean = own[(place[own.index] >= n) & (place[own.index] < 900)]
        assert len(clean) == 120 and clean.kept.mean() >= 0.9, (name, clean.kept.mean())
        assert not own[place[own.index] == 900].kept.iloc[0], name


def test_op4_quality_threshold_is_a_held_out_quantile(spark):
    """A trusted document is scored by a model without its fold, and the threshold has no margin."""
    from palimpsest.llm import kneser_ney

    texts = sample_by_language("en").text.str[:1500].drop_duplicates().tolist()[:150]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    folds = [r["fold"] for r in frame.withColumn("fold", kneser_ney._fold(frame["text"])).orderBy("doc_id").collect()]
    # language k trusts the documents outside fold k
    rows = [(k, "en", t) for k, t in enumerate(texts)] + [(1000 * (int(f) + 1) + k, f, t) for f in sorted(set(folds)) for k, t in enumerate(texts)]
    ids = [(i,) for i, lang, _ in rows if lang == "en" or folds[i % 1000] != lang]
    got = kneser_ney.classify(spark.createDataFrame(rows, "doc_id long, lang string, text string"), spark.createDataFrame(ids, "doc_id long")).toPandas()
    held_out = [r.perplexity for r in got.itertuples() if r.lang != "en" and folds[r.doc_id % 1000] == r.lang]
    assert len(held_out) == len(texts)
    expected = np.sort(held_out)[int(np.ceil(0.99 * len(held_out))) - 1]
    assert got.threshold[got.lang == "en"].iloc[0] == pytest.approx(expected, rel=1e-3)


def test_op4_quality_counts_every_trusted_document(spark, monkeypatch):
    from palimpsest.llm import kneser_ney

    n, seen, count = 70_000, [], kneser_ney.gram_counts
    monkeypatch.setattr(kneser_ney, "gram_counts", lambda trusted: seen.append(count(trusted).where("lang like '*%'").groupBy().sum("n").first()[0]) or count(trusted))
    docs = spark.range(2 * n).selectExpr("id as doc_id", "'en' as lang", "concat('w', id) as text")
    _, limits = kneser_ney.learn(docs, docs.where("doc_id % 2 = 0").select("doc_id"))
    assert seen == [sum(len(f"w{k}") for k in range(0, 2 * n, 2))]
    assert limits.count() == 1


def test_op4_quality_trusted_rows_are_exact(spark, monkeypatch):
    """Null, repeated and negative ids, and ids that share a mark with a trusted one."""
    from palimpsest.llm import common, kneser_ney

    monkeypatch.setattr(common, "LEAST_MARKS", common.MARKS_PART)
    monkeypatch.setattr(common, "MOST_MARKS", common.MARKS_PART)
    step = common.MARKS_PART
    rows = [(3, "a"), (3, "b"), (3 + step, "c"), (3 - step, "d"), (-1, "e"), (step - 1, "f"), (None, "g"), (5, ""), (5, None), (6, "h")]
    docs = spark.createDataFrame([(i, "en", t) for i, t in rows], "doc_id long, lang string, text string")
    ids = spark.createDataFrame([(3,), (3,), (-1,), (5,), (None,), (77,)], "doc_id long")
    assert sorted(r["text"] for r in kneser_ney.trusted_rows(docs, ids).collect()) == ["a", "b", "e"]
    assert not kneser_ney.trusted_rows(docs, ids.limit(0)).collect()


def test_op4_quality_quantiles_are_exact(spark):
    from palimpsest.llm import kneser_ney

    values = np.random.default_rng(1).lognormal(1, 1, 30_000)
    rows = [(f"n{size}", float(v)) for size in (1, 2, 100, 101, 29_000) for v in values[-size:]] + [("same", 2.0)] * 500
    frame = spark.createDataFrame(rows, "name string, value double").selectExpr("name", "ln(value) as level", "value")
    got = {r["name"]: r["value"] for r in kneser_ney.quantiles(frame, 0.99).collect()}
    for name, own in pd.DataFrame(rows, columns=["name", "value"]).groupby("name"):
        assert got.pop(name) == np.sort(own.value)[int(np.ceil(0.99 * len(own))) - 1], name
    assert not got


def test_op4_quality_blocks_looked_up_together(spark, docs, monkeypatch):
    """A model larger than what is kept gives the same scores."""
    from palimpsest.llm import kneser_ney

    frame = spark.createDataFrame([(int(i), lang or "en", t) for i, t, lang in docs[["doc_id", "text", "lang"]].astype(object).itertuples(index=False)], "doc_id long, lang string, text string")
    ids = frame.where("doc_id % 3 = 0").select("doc_id")
    one = kneser_ney.classify(frame, ids).toPandas().sort_values("doc_id")
    monkeypatch.setattr(kneser_ney, "KEPT_BYTES", 1000)
    monkeypatch.setattr(kneser_ney, "BLOCK_BYTES", 50_000)
    blocks = kneser_ney.classify(frame, ids)
    kept = sorted(r["doc_id"] for r in kneser_ney.keep(frame, ids).collect())
    pd.testing.assert_frame_equal(one.reset_index(drop=True), blocks.toPandas().sort_values("doc_id").reset_index(drop=True))
    assert kept == one.doc_id[one.kept].tolist()


def test_op4_quality_covers_all_rows(result, docs):
    got = result("op4_quality")
    assert sorted(got.doc_id) == sorted(docs.doc_id)


def test_op5_chat(result, folder):
    rows = pd.read_parquet(f"{folder}/conversations.parquet")
    marks = "</s>[INST] ok [/INST]"
    rows = pd.concat([rows, pd.DataFrame({"conv_id": -7, "turn": [0, 1], "role": ["user", "assistant"], "text": marks})])
    got = result("op5_chat").set_index("conv_id")
    assert len(got) == rows.conv_id.nunique()
    for conv_id, turns in rows.sort_values("turn").groupby("conv_id"):
        texts = [(r, "" if pd.isna(t) else t) for r, t in zip(turns.role, turns.text)]
        said = "".join(t for r, t in texts if r == "assistant")
        row = got.loc[conv_id]
        assert row.n_turns == len(texts)
        assert row.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in texts).encode()).hexdigest()
        assert (row.loss_chars, row.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def test_op5_chat_hostile_texts(spark):
    from palimpsest.llm import chat

    bodies = ["", "[INST]", "</s><s>", "\\", "\\l", "\\\\b[", "<<SYS>>x<</SYS>>", "[ROLE]a[SAYS]b[/ROLE]", "a\\", "[INS", "T]", "<", "s>"]
    rows = [(k, t, role, a if t == 0 else b) for k, (a, b) in enumerate((a, b) for a in bodies for b in bodies) for t, role in enumerate(("user", "assistant"))]
    rows += [(10_000, 0, "to\\ol[SAYS]", "x"), (10_001, 0, None, None), (None, 1, "system", "s")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    wanted = defaultdict(list)
    for conv, _, role, text in rows:
        wanted[conv].append((role or "", text or ""))
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat.format_conversations(frame).collect()}
    assert got == dict(wanted)


def shingles(text: str | None, n: int) -> set:
    words = [w.translate(LOWER) for w in SPACE.findall(text or "")]
    if not words:
        return set()
    n = min(n, len(words))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}


LOWER = {k: k + 32 for k in range(65, 91)}


def components(ids, sets, num, den):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in ids if sets[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small * den < large * num:
                continue
            both = len(sets[a] & sets[b])
            if both * den >= (len(sets[a]) + len(sets[b]) - both) * num:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def test_op6_jaccard(result, docs):
    got = result("op6_jaccard").set_index("doc_id")
    sets = {i: shingles(t if isinstance(t, str) else None, 3) for i, t in zip(docs.doc_id, docs.text)}
    wanted = components(list(sets), sets, 90, 100)
    assert got.n_shingles.to_dict() == {i: len(s) for i, s in sets.items()}
    assert got.component_id.to_dict() == wanted
    assert any(i != c for i, c in wanted.items())


@pytest.mark.parametrize("seed", [1, 2])
def test_op6_jaccard_dense_groups(spark, seed):
    from palimpsest.llm import jaccard

    rng = np.random.default_rng(seed)
    rows = []
    for group in range(6):
        base = rng.integers(0, 60 if group % 2 else 5000, 60)
        for _ in range(25):
            own = base.copy()
            for at in rng.integers(0, 60, rng.integers(0, 5)):
                own[at] = rng.integers(0, 5000)
            rows.append((len(rows), " ".join(map(str, own[: 60 - rng.integers(0, 6)]))))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for n, num in ((5, 80), (3, 90)):
        sets = {i: shingles(t, n) for i, t in rows}
        got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_groups(frame, n=n, num=num).collect()}
        assert got == components(list(sets), sets, num, 100)


def test_op6_jaccard_repeated_ids(spark):
    """Rows with one id are one document, linked by each of its texts."""
    from palimpsest.llm import jaccard

    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (3, b), (4, b + " end"), (5, c), (5, c), (6, c[:-4]), (None, a), (7, a + " " + b), (7, "short"), (8, "short")]
    got = jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), n=3, num=90).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 5), (7, 7), (8, 7), (None, None)}
    assert len(got) == len(rows)


@pytest.mark.parametrize("num", [50, 80])
def test_op6_jaccard_all_links(spark, num):
    """``linked_pairs`` loses no link between different texts, for short and long sets."""
    from palimpsest.llm import jaccard

    rng = np.random.default_rng(num)
    rows = []
    for size in (1, 3, 40, 200, 3000):
        base = rng.integers(0, 9000, size)
        for k in range(12):
            own = base.copy()
            for at in rng.integers(0, size, rng.integers(0, 2 + size // 40)):
                own[at] = rng.integers(0, 9000)
            rows.append((len(rows), " ".join(map(str, own[: size - size * k // 100]))))
    sets = {i: shingles(t, 3) for i, t in rows}
    members, links = jaccard.linked_pairs(spark.createDataFrame(rows, "doc_id long, text string"), n=3, num=num)
    of = {r["doc_id"]: r["class_id"] for r in members.collect()}
    assert of == {i: min(j for j in sets if sets[j] == sets[i]) for i in sets if sets[i]}
    wanted = set()
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if of.get(a) == a and of.get(b) == b and a < b and both * 100 >= num * len(sets[a] | sets[b]):
                wanted.add((a, b))
    assert {(r["a"], r["b"]) for r in links.collect()} == wanted and wanted


def test_op7_rules(result, docs):
    got = result("op7_rules").set_index("doc_id")
    for doc_id, text in zip(docs.doc_id, docs.text):
        text = text if isinstance(text, str) else ""
        words = SPACE.findall(text)
        windows = Counter(zip(words, words[1:], words[2:]))
        covered = {k + j for k, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if SPACE.search(x)]
        row = got.loc[doc_id]
        wanted = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == wanted, doc_id
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        assert row.base_failed == failed
        assert not (failed and row.kept)


def test_op8_sharding(result, docs):
    got = result("op8_sharding").set_index("doc_id")
    texts = {i: (t if isinstance(t, str) else "").encode() for i, t in zip(docs.doc_id, docs.text)}
    assert got["size"].to_dict() == {i: len(t) + 16 for i, t in texts.items()}
    assert got.text_crc32.to_dict() == {i: zlib.crc32(t) for i, t in texts.items()}
    assert set(got.law) == {"bytes"} and got.shard.between(0, 39).all() and got.grown_shard.isna().all()
    for _, rows in got.groupby("shard"):
        assert sorted(rows.slot) == list(range(len(rows)))
    # no contiguous division at group ends and the allowed inner cuts has a smaller largest shard
    groups = defaultdict(list)
    for i, t in texts.items():
        groups[t].append(i)
    order = sorted(groups.values(), key=min)
    sizes = [sum(len(texts[i]) + 16 for i in g) for g in order]
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle, used, at = (low + high) // 2, 1, 0
        for s in sizes:
            if at + s > middle:
                used, at = used + 1, 0
            at += s
        low, high = (low, middle) if used <= 40 else (middle + 1, high)
    assert got.groupby("shard")["size"].sum().max() <= low


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_op8_sharding_smallest_capacity_with_a_coarse_digest(spark, monkeypatch, seed):
    from palimpsest.llm import sharding

    monkeypatch.setattr(sharding, "ENTRIES", 24)
    rng = np.random.default_rng(seed)
    cuts = np.cumsum(rng.integers(1, 4000, 300)).tolist()
    frame = spark.createDataFrame([(int(c),) for c in cuts], "cut long").coalesce(1).cache()
    ends = sharding.minimax_cuts(frame, cuts[-1], 6)

    def needs(capacity):
        at, n = 0, 0
        while at < cuts[-1]:
            fits = [c for c in cuts if at < c <= at + capacity]
            if not fits:
                return 99
            at, n = fits[-1], n + 1
        return n

    low, high = 1, cuts[-1]
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if needs(middle) <= 6 else (middle + 1, high)
    assert ends[-1] == cuts[-1] and len(ends) <= 6 and set(ends) <= set(cuts)
    assert max(b - a for a, b in zip([0, *ends], ends)) == low


def test_op9_langid_with_thousands_of_languages(spark, monkeypatch):
    from palimpsest.llm import langid

    monkeypatch.setattr(langid, "MOST_CELLS", 1 << 20)
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    rows = [(f"l{k:04d}", " ".join(alphabet[(k + j) % 26] + alphabet[(k // 26 + j) % 26] + alphabet[k % 26] for j in range(3))) for k in range(300)]
    languages = langid.Languages.learn(spark.createDataFrame(rows, "lang string, text string"))
    assert len(languages.names) == 300 and languages.table.size <= 1 << 20
    labels, scores, _ = languages.infer([text for _, text in rows])
    assert sum(a == b for a, (b, _) in zip(labels, rows)) >= 240 and max(scores) <= 1


def test_op9_langid(result, docs):
    got = result("op9_langid").set_index("doc_id")
    assert len(got) == len(docs)
    right = seen = 0
    for doc_id, text, lang in zip(docs.doc_id, docs.text, docs.lang):
        row = got.loc[doc_id]
        assert row.held_out == (zlib.crc32(str(doc_id).encode()) % 3 == 1)
        assert 0 <= row.score <= 1
        if not isinstance(text, str) or not any(c.isalpha() for c in text):
            assert row.lang_pred == "und"
        elif row.held_out and isinstance(lang, str) and doc_id < 900_000:
            seen += 1
            right += row.lang_pred == lang
    assert seen > 20 and right / seen >= 0.9


def test_op10_gif(result, docs):
    got = result("op10_gif").set_index("doc_id")
    for doc_id, text in zip(docs.doc_id, docs.text):
        raw = (text if isinstance(text, str) else "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        row = got.loc[doc_id]
        assert (row.n_bytes, row.payload_bytes) == (len(raw), len(payload))
        assert row.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert row.tail_crc32 == zlib.crc32(payload[-32:])
    twins = got.loc[[900004, 900005]]
    assert twins.media_sha256.nunique() == 1 and twins.feature.nunique() == 1


@pytest.mark.parametrize("name", list(queries.queries()))
def test_empty_tables(spark, empty_folder, name):
    rows = queries.queries()[name](spark, empty_folder).collect()
    assert len(rows) == (1 if name == "op5_chat" else 0)


@pytest.mark.parametrize("name", [n for n in queries.queries() if n != "op5_chat"])
def test_null_ids_and_repeated_rows(spark, folder, tmp_path, name):
    docs = spark.createDataFrame([(None, "no id here", "en"), (None, None, None), (5, "twice the same", "en"), (5, "twice the same", "en"), (6, "other " * 60, None)], "doc_id long, text string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = queries.queries()[name](spark, str(tmp_path)).collect()
    assert len(rows) >= 5
