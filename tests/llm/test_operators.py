"""Each operator against its plain version, on messy rows and on none."""

import gzip
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rulefold.llm import classifier
from rulefold.llm import jaccard_join as jj
from rulefold.llm import suffix_dedup as sd
from rulefold.llm import warc
from rulefold.llm.bytelevel import vocabulary
from rulefold.llm.chat import escaped, format_chats, read_chats, unescaped
from rulefold.llm.classifier import Settings, fit, score
from rulefold.llm.exact_dedup import exact_dedup, without_duplicates
from rulefold.llm.graph import components
from rulefold.llm.mixing import mix, source_targets, whole_documents
from rulefold.llm.packing import pack_documents, plan_packing, runs, tokenised_pieces
from rulefold.llm.quality_rules import clean_texts, quality_rules
from rulefold.llm.token_counts import token_counts
from tests.llm import brute

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoded(corpus):
    tokenizer = Tokenizer.from_file(PATH)
    return [e.ids for e in tokenizer.encode_batch([t or "" for _, t, _ in corpus], add_special_tokens=False)]


# --- 1 chat formatting


def test_chats_round_trip(spark):
    odd = ["", "\\", "\\\\<|", "<|turn|>user<|text|>", "</s>[INST] ok [/INST]", "<<|<|", "a\\<", "<<SYS>>x<</SYS>>", "<|next|><|end|>", "\U0001F600é\n", "x" * 200_000]
    rows = [(1, k, ("user", "assistant")[k // 2 % 2], t) for k, t in enumerate(odd)]
    rows += [(2, 0, None, None), (2, None, "assistant", "first"), (2, 5, "assistant", "tie b"), (2, 5, "assistant", "tie a"), (None, 0, "us<|er", "no id"), (3, 0, "user", "r"), (3, 0, "user", "r")]
    turns = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id int, turn int, role string, text string, turns int, formatted string").repartition(4)
    got = {r.conv_id: r for r in read_chats(format_chats(turns)).collect()}
    assert len(got) == 4
    assert [tuple(t) for t in got[1].turns] == [(r, t) for _, _, r, t in rows[: len(odd)]]
    assert got[1].loss_text == "".join(t for _, _, r, t in rows[: len(odd)] if r == "assistant")
    assert [tuple(t) for t in got[2].turns] == [("assistant", "first"), ("", ""), ("assistant", "tie a"), ("assistant", "tie b")]
    assert [tuple(t) for t in got[None].turns] == [("us<|er", "no id")]
    assert [tuple(t) for t in got[3].turns] == [("user", "r")] * 2
    assert got[1].formatted.count("<|turn|>") == 6  # neighbours of one role share a block
    assert read_chats(format_chats(turns.where("1 = 0"))).count() == 0


def test_escapes_are_reversible(spark):
    texts = ["".join(x) for x in __import__("itertools").product("<|\\s>/", repeat=4)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escaped(F.col("t")).alias("e")).withColumn("u", unescaped(F.col("e")))
    rows = df.collect()
    assert all(r.t == r.u and "<|" not in r.e and "</s>" not in r.e for r in rows)


def test_chats_run_without_python(spark, sf):
    from rulefold.llm.queries import QUERIES

    plan = QUERIES["op1_chat_formatting"](spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- 2 suffix arrays


@pytest.mark.parametrize("settings", [sd.Settings(), sd.Settings(group=2), sd.Settings(least=40, gram=10, batch=5)])
def test_repeats(frame, corpus, settings):
    # rows of one id are ordered by a hash of their text: compare the ids that occur once
    rows = [(i, t) for i, t, _ in corpus]
    once = [i for i, n in Counter(i for i, _ in rows).items() if n == 1 and i is not None]
    rows = [(i, t) for i, t in rows if i in once]
    got = {r.doc_id: r for r in sd.remove_repeats(frame.where(F.col("doc_id").isin(once)), settings).collect()}
    assert len(got) == len(rows)
    for (i, t), (kept, removed, spans) in zip(rows, brute.without_repeats(rows, settings.least), strict=True):
        r = got[i]
        assert (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) == (len(brute.utf8(t)), removed, spans, kept), i


def test_repeats_of_equal_ids_and_nothing(frame, corpus, nothing):
    got = sd.remove_repeats(frame).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in corpus)
    assert sum(r.n_removed > 0 for r in got) > 30
    assert sd.remove_repeats(nothing).count() == 0


def test_nested_repeat_groups_give_merged_spans():
    """Contexts of one anchor that share more and more bytes are in many nested groups; what they remove is a few spans each."""
    s, n = sd.Settings(least=20, gram=5), 60
    contexts = [b"x" * 30 + bytes([97 + k % 3]) * (k % 9) + b"y" * 20 + bytes([65 + k // 3]) for k in range(n)]
    body, length = np.frombuffer(b"".join(contexts), np.uint8), np.array([len(c) for c in contexts])
    start = np.arange(n) * 7
    ids, texts, opens, closes = sd._repeats(body, np.cumsum(length) - length, length, np.arange(n) // 2, np.arange(n) % 2, start, s)
    assert len(ids) <= 3 * n
    seen, want = set(), set()
    for k, c in enumerate(contexts):
        windows = [c[i : i + 20] for i in range(len(c) - 19)]
        for i, w in enumerate(windows):
            want |= {(k // 2, k % 2, start[k] + j) for j in range(i, i + 20)} if w in seen else set()
            seen.add(w)
    assert {(i, t, j) for i, t, a, b in zip(ids, texts, opens, closes, strict=True) for j in range(a, b)} == want


def test_maximal_repeat_groups():
    text = b"xabcdyabcdzabcx"
    rows = np.frombuffer(text, np.uint8)[None, :]
    at, common = sd.enhanced_suffix_array(rows, np.array([len(text)]), 2)
    assert [text[k:] for k in at] == sorted(text[k:] for k in range(len(text) - 1))
    before = np.where(at > 0, rows[0, np.maximum(at - 1, 0)].astype(int), -1)
    groups = {text[at[a] : at[a] + n]: sorted(at[a : b + 1].tolist()) for a, b, n in sd.repeat_groups(at, common, before, 2).tolist()}
    assert groups == {b"abcd": [1, 6], b"abc": [1, 6, 11]}  # bcd, cd and bc extend to the left


def test_contexts_with_one_hash_are_told_apart_by_their_bytes():
    data = np.frombuffer(b"abcabcabdabcabab", np.uint8)
    start, length = np.array([0, 3, 6, 9, 12, 14]), np.array([3, 3, 3, 3, 2, 2])
    same = sd._repeats_previous(np.arange(6), [np.zeros(6, np.uint64)], data, start, length)
    assert same.tolist() == [False, True, False, False, False, True]
    assert sd._repeats_previous(np.zeros(0, np.int64), [np.zeros(0)], data, start[:0], length[:0]).tolist() == []


# --- 3 classifier


def test_classifier(spark, nothing):
    rng = np.random.default_rng(1)
    good = [" ".join(rng.choice(["the", "sun", "was", "low", "over", "hills", "and"], 30)) for _ in range(150)]
    bad = [" ".join(rng.choice(["BUY!!", "NOW$$$", "CLICK##", "the"], 30)) for _ in range(150)]
    rows = [(k, t, k % 2 == 0) for k, t in enumerate(x for pair in zip(good, bad, strict=True) for x in pair)]
    docs = spark.createDataFrame([(k, t, "x") for k, t, _ in rows] + [(998, None, "x"), (999, "", "x"), (None, "the sun", "x"), (0, rows[0][1], "x")], "doc_id bigint, text string, label string")
    labels = spark.createDataFrame([(k, int(y), 0) for k, _, y in rows] + [(None, 1, 0), (5, None, 0), (0, 1, 1)], "doc_id bigint, quality int, toxic int")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    weights = fit(docs, labels, fold != 2)
    assert (weights == fit(docs.repartition(5), labels.repartition(3), fold != 2)).all()
    got = [(r.doc_id, r.score) for r in score(docs, weights).collect()]
    truth = {k: y for k, _, y in rows}
    held = [(truth[i] == (p >= 0.7)) for i, p in got if i in truth and zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 50 and np.mean(held) > 0.97
    assert all(0 <= p <= 1 for _, p in got) and len(got) == 304
    assert len({p for i, p in got if i in (998, 999)}) == 1 and len({p for i, p in got if i == 0}) == 1
    assert score(nothing.drop("score"), weights).count() == 0
    with pytest.raises(ValueError):
        score(nothing, weights)
    untrained = fit(docs, labels.where("1 = 0"), fold != 2)
    assert {r.score for r in score(docs, untrained).collect()} == {0.5}
    small = Settings(max_rows=40)
    assert fit(docs, labels, fold != 2, small).any()


# --- 4 token counts


def test_token_counts(frame, corpus, nothing, encoded):
    got = Counter(map(tuple, token_counts(frame, PATH).collect()))
    assert got == Counter((i, len(brute.utf8(t)), len(ids)) for (i, t, _), ids in zip(corpus, encoded, strict=True))
    assert token_counts(nothing, PATH).count() == 0


def test_merges_by_rank():
    v = vocabulary(PATH)
    words = [b"aaaaaaa", b"lower", b" ", b"z", "ééé".encode(), b"!" * 70]
    data = np.frombuffer(b"".join(words), np.uint8)
    lengths = np.array([len(w) for w in words])
    tokenizer = Tokenizer.from_file(PATH)
    expected = [tokenizer.encode(w.decode(), add_special_tokens=False).ids for w in words]
    sizes, ids = v.merged_ids(data, np.cumsum(lengths) - lengths, lengths)
    assert sizes.tolist() == [len(e) for e in expected] and ids.tolist() == sum(expected, [])


# --- 5 Jaccard join


@pytest.mark.parametrize("settings", [
    jj.Settings(words=4, percent=85), jj.Settings(), jj.Settings(words=2, percent=60), jj.Settings(words=3, percent=70, region=300, pivots=3, rounds=2), jj.Settings(region=50, rounds=1)])
def test_near_duplicates(frame, corpus, settings):
    rows = [(i, t) for i, t, _ in corpus]
    keep = brute.linked_components(rows, settings.words, settings.percent)
    expected = Counter((i, len(brute.shingles(t, settings.words)), keep.get(i)) for i, t in rows)
    assert Counter(map(tuple, jj.near_duplicates(frame, settings).collect())) == expected


def test_near_duplicates_of_nothing(nothing):
    assert jj.near_duplicates(nothing).count() == 0


def test_region_join_finds_every_link():
    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(0, 2**60, 60)).astype(np.uint64) for _ in range(5)]
    sets = []
    for b in base:
        for _ in range(25):
            keep = rng.random(len(b)) < rng.choice([0.8, 0.9, 0.97])
            sets.append(np.unique(np.append(b[keep], rng.integers(0, 2**60, rng.integers(0, 6)).astype(np.uint64))))
    s = jj.Settings()
    forest = jj.join_region(sets, s)
    plain = jj.Forest(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= s.percent * (len(sets[i]) + len(sets[j]) - both):
                plain.join(i, j)
    assert [forest.root(k) for k in range(len(sets))] == [plain.root(k) for k in range(len(sets))]


def _cluster(seed: int, n: int, least: float) -> list[np.ndarray]:
    """A base of 100 shingles and sets that hold a share of it, from `least` on, and shingles of their own instead."""
    rng = np.random.default_rng(seed)
    base = np.unique(rng.integers(0, 2**60, 100)).astype(np.uint64)
    sets = [base]
    for k in range(n):
        keep = rng.random(len(base)) < least + (1 - least) * k / n
        sets.append(np.unique(np.append(base[keep], rng.integers(0, 2**60, len(base) - keep.sum()).astype(np.uint64))))
    return sets


def _plain_roots(ids, sets, s):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for m, x in enumerate(sets):
        for k in range(m):
            both = len(np.intersect1d(x, sets[k]))
            if 100 * both >= s.percent * (len(x) + len(sets[k]) - both):
                a, b = root(ids[m]), root(ids[k])
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_split_regions_copies_no_row(spark):
    """All near copies of a text are about as far from every pivot; copies in the cells of all of them grow with the power of the rounds."""
    sets = _cluster(7, 150, 0.75)
    s = jj.Settings(region=1000)
    members = spark.createDataFrame([("r", k, bytearray(v.tobytes())) for k, v in enumerate(sets)], "region string, id bigint, shingles binary")
    links, left = jj.split_regions(members, s)
    ids = [r.id for r in left.collect()]
    assert len(ids) == len(set(ids)) < len(sets) and links.count() > 30
    # what has under 80 of its 100 shingles in common with others links with none, and goes
    assert not {k for k, v in enumerate(sets) if k and len(np.intersect1d(v, sets[0])) < 78} & set(ids)


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_link_edges_of_large_regions(spark, rounds):
    """Several clusters that share a passage in one region, rows that come twice, an id with several sets, extreme ids."""
    passage = np.arange(1, 60, dtype=np.uint64)
    sets = [np.unique(np.append(v, passage)) for seed in (1, 2, 3) for v in _cluster(seed, 60, 0.7)]
    ids = [-(2**63), *range(1, len(sets) - 2), 5, 2**63 - 1]
    s = jj.Settings(region=2000, rounds=rounds, pivots=3)
    rows = [("r", i, bytearray(v.tobytes())) for i, v in zip(ids, sets, strict=True)]
    members = spark.createDataFrame(rows + rows[::3], "region string, id bigint, shingles binary")
    found = {i: i for i in ids} | dict(map(tuple, components(jj.link_edges(members, s)).collect()))
    assert found == _plain_roots(ids, sets, s)


def test_components(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, 3), (3, 7), (3, 9), (500, 1)] + [(1000 + k, 1000) for k in range(50)] + [(5, 5)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {k: 100 for k in range(100, 161)} | {3: 3, 7: 3, 9: 3, 1: 1, 500: 1} | {1000 + k: 1000 for k in range(50)}


@pytest.mark.parametrize("texts", [[None, "", " \n"], ["one two", "two three", "x"], ["one", None, ""], ["a b c d e f g h", "i j k l m n o p", "q r s t u v w x y z"]])
def test_tables_without_shared_keys(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.near_duplicates(df, jj.Settings(words=4, percent=85)).collect()}
    assert got == {k: (len(brute.shingles(t, 4)), k) for k, t in enumerate(texts)}


@pytest.mark.parametrize("percent", [51, 55, 60, 66, 67, 70, 75, 80, 85, 100])
def test_small_sets_that_link_share_a_key(percent):
    rng = np.random.default_rng(percent)
    s = jj.Settings(percent=percent)
    linked = 0
    for _ in range(4000):
        n = int(rng.integers(1, 12))
        x = rng.integers(0, 2**63, n).astype(np.uint64)
        y = np.concatenate([x[rng.random(n) < 0.9], rng.integers(0, 2**63, int(rng.integers(0, 3))).astype(np.uint64)])
        x, y = np.unique(x), np.unique(y)
        both = len(np.intersect1d(x, y))
        if both and np.array_equal(x, y) is False and 100 * both >= percent * (len(x) + len(y) - both):
            linked += 1
            assert len(np.intersect1d(jj.keys_of(x, np.zeros(0, np.uint64), s), jj.keys_of(y, np.zeros(0, np.uint64), s)))
    assert linked > 50 or percent == 100


def test_percent_out_of_range():
    with pytest.raises(ValueError):
        jj.Settings(percent=50)


# --- 6 mixing


def test_mixing(frame, corpus, nothing):
    sizes = defaultdict(int)
    for _, t, s in corpus:
        sizes[s] += len(brute.WORD.findall(brute.utf8(t)))
    expected = brute.targets(sizes, (5, 2, 1), 3)
    keep = ["doc_id", "source", "text"]
    got = mix(frame, keep_columns=keep).collect()
    assert Counter((r.doc_id, r.source, r.text) for r in got) == Counter(corpus_key for corpus_key in ((i, s, t) for i, t, s in corpus))
    taken = defaultdict(int)
    for r in got:
        assert r.size == len(brute.WORD.findall(brute.utf8(r.text))) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(expected[r.source])
        words = r.epochs * r.size + r.part
        assert 0 <= r.part <= r.size and words <= 3 * r.size
        taken[r.source] += words
    for s, t in expected.items():
        assert abs(taken[s] - t) <= 1 or sizes[s] == 0
    again = mix(frame.repartition(7), keep_columns=keep).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    whole = Counter((r.doc_id, r.text) for r in whole_documents(frame).collect())
    for r in got:
        assert whole[r.doc_id, r.text] >= r.epochs
    assert mix(nothing, keep_columns=keep).count() == 0
    with pytest.raises(ValueError):
        mix(frame)


def test_capped_targets(spark):
    for sizes in ({"a": 10, "b": 10, "c": 1000}, {"a": 1, "b": 1, "c": 1}, {"a": 0, "b": 5, None: 100}, {"x": 3}):
        df = spark.createDataFrame(list(sizes.items()), "source string, words bigint")
        got = {r.source: r.target for r in source_targets(df, "source", "words", (5, 2, 1), 3.0).collect()}
        assert got == pytest.approx(brute.targets(sizes, (5, 2, 1), 3))


# --- 7 quality rules


def test_quality_rules(frame, corpus, nothing):
    got = quality_rules(frame, min_line_documents=3, max_line_share=0.05).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in corpus)
    lines, hosts = defaultdict(set), Counter(s for _, _, s in corpus)
    norm = lambda x: tuple(brute.WORD.findall(x.lower()))
    for n, (_, t, s) in enumerate(corpus):
        for x in brute.utf8(t).split(b"\n"):
            if norm(x):
                lines[s, norm(x)].add(n)
    expected = Counter()
    for i, t, s in corpus:
        b = brute.utf8(t)
        words, seen, dup, lost = brute.WORD.findall(b), set(), 0, 0
        for x in b.split(b"\n"):
            if norm(x):
                dup += x in seen
                seen.add(x)
                k = len(lines[s, norm(x)])
                lost += len(norm(x)) if k > 3 and k > 0.05 * hosts[s] else 0
        grams = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        twice = Counter(grams)
        covered = {k + j for k, g in enumerate(grams) if twice[g] > 1 for j in range(8)}
        failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
        kept = not failed and not (lost and len(words) - lost < 0.2 * len(words))
        expected[i, len(words), sum(len(w.decode()) for w in words), sum(c in b"#*$%&|<>" for c in b), dup, len(covered), failed, lost, kept] += 1
    assert Counter(map(tuple, got)) == expected
    assert any(r.n_boilerplate_words for r in got) and any(not r.kept and not r.base_failed for r in got)
    assert quality_rules(nothing).count() == 0


def test_clean_texts(spark, frame, corpus, nothing):
    lines, hosts = defaultdict(set), Counter(s for _, _, s in corpus)
    norm = lambda x: tuple(brute.WORD.findall(x.lower()))
    for n, (_, t, s) in enumerate(corpus):
        for x in brute.utf8(t).split(b"\n"):
            lines[s, norm(x)].add(n)
    common = {k for k, d in lines.items() if k[1] and len(d) > 3 and len(d) > 0.05 * hosts[k[0]]}
    expected = Counter()
    for i, t, s in corpus:
        left = b"".join(x for x in re.findall(rb"[^\n]*\n|[^\n]+", brute.utf8(t)) if (s, norm(x)) not in common)
        expected[i, None if t is None else left.decode()] += 1
    out = clean_texts(frame, min_line_documents=3, max_line_share=0.05).collect()
    assert Counter((r.doc_id, r.text) for r in out) == expected
    assert set(expected) - {(i, t) for i, t, _ in corpus}
    assert clean_texts(nothing).count() == 0
    # the line goes from one host only, in any spelling, first, amid and last, and a text may be empty afterwards
    rows = [(1, "a", "Click  HERE\né\nclick here\n\nz"), (2, "a", "x\nclick here"), (3, "a", "click here"), (4, None, "click here"), (5, "b", "click here\ny")]
    small = spark.createDataFrame([(i, h, t) for i, h, t in rows], "k int, h string, body string")
    got = clean_texts(small, "k", "h", "body", min_line_documents=1).collect()
    assert {r.k: (r.body, r.n_boilerplate_words) for r in got} == {
        1: ("é\n\nz", 4), 2: ("x\n", 2), 3: ("", 2), 4: ("click here", 0), 5: ("click here\ny", 0)}


def test_verdict_on_the_text_left(spark):
    line = " ".join("terms and conditions of use apply to every page here".split())  # 10 words
    rows = [(1, line, 19), (2, line, 20), (3, line, 90), (4, "", 20), (5, "", 19), (6, line, 0), (7, line, 1)]
    texts = spark.createDataFrame([(k, "a", t + "\n" + " ".join(f"w{k}x{j}" for j in range(n))) for k, t, n in rows], "doc_id int, source string, text string")
    limits = {"min_line_documents": 3, "max_line_share": 0.05}
    assert {r.doc_id for r in clean_texts(texts, **limits).where("kept").collect()} == {2, 3, 4}
    assert {r.doc_id for r in clean_texts(texts, **limits, min_left_words=0).where("kept").collect()} == {1, 2, 3, 4}
    # the registered SQL judges the share alone
    assert {r.doc_id for r in quality_rules(texts, **limits).where("kept").collect()} == {1, 2, 3, 4}
    assert {r.doc_id for r in quality_rules(texts, **limits, min_left_words=None).where("kept").collect()} == {2, 3, 4}


# --- 8 web archives


def test_archives(spark):
    long = "é" * 30_000
    rows = [(1, "u", long), (2, "u", long), (2, "u", long), (3, None, "short"), (4, "u\r\nx", "short"), (5, "u", None), (None, "u", "<p>\r\n\r\n</p>"), (6, "u", "WARC/1.1\r\n\r\n" * 500), (7, "u", "")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id int, url string, html string, type string").repartition(3)
    got = Counter(tuple(r) for r in warc.round_trip(pages, segment=1000, chunk=300).collect())
    expected = Counter()
    for i, _, t in rows:
        b, to = brute.utf8(t), "2" if t == long and i == 1 else None
        expected[None if i is None else str(i), "revisit" if to else "response", to, len(b), hashlib.sha1(b).hexdigest(), None] += 1
    assert got == expected
    assert warc.round_trip(pages.where("1 = 0")).count() == 0


def test_broken_archives(spark):
    content = warc.http_message(b"x" * 100, 30)
    assert warc.http_payload(content) == b"x" * 100
    head = [("WARC-Type", "response"), ("WARC-Record-ID", "<a>")]
    records = [(h, c) for h, c in warc.parse(b"".join(warc.record(head, content) + warc.END for _ in range(2)))]
    assert len(records) == 2 and records[0][1] == content
    row = ("response", "<a>", None, "<a>", 1, None, None, content[:50])
    last = ("continuation", "<b>", None, "<a>", 3, len(content), None, content[50:])
    cases = {"segments are missing": [row, last], "the segments have another total length": [row, (*last[:4], 2, 5, *last[6:])], None: [row, (*last[:4], 2, *last[5:])]}
    for problem, rows in cases.items():
        out = warc.reassemble(spark.createDataFrame(rows, warc.RECORD)).collect()
        assert [r.problem for r in out] == [problem]
    assert bytes(out[0].payload) == b"x" * 100
    with pytest.raises(ValueError):
        warc.http_payload(content[:60])
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort"))


# --- 9 packing


def test_packing(frame, corpus, nothing, encoded):
    got = pack_documents(frame, PATH).collect()
    documents = defaultdict(list)
    for (i, _, _), ids in zip(corpus, encoded, strict=True):
        documents[i].append([*ids, 2])
    expected = Counter()
    for i, all_ids in documents.items():
        for ids in all_ids:
            short, start, piece = (len(ids) - 1) % 1024 + 1, 0, 0
            while start < len(ids):
                n = short if not start else 1024
                expected[i, piece, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())] += 1
                start, piece = start + n, piece + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == np.append(0, np.cumsum([n for _, n in parts]))[:-1].tolist() and sum(n for _, n in parts) <= 1024
    assert len(sequences) <= -(-sum(r.length for r in got) // 1024) + 1
    assert pack_documents(nothing, PATH).count() == 0
    ids = tokenised_pieces(frame.where("doc_id = 62"), PATH, with_ids=True).first()
    assert ids.ids == [*next(e for (i, _, _), e in zip(corpus, encoded, strict=True) if i == 62), 2]


def test_packing_plan():
    rng = np.random.default_rng(2)
    for capacity, lengths in ((10, [10] * 3 + [6, 4, 5, 5, 5, 2, 2, 1]), (64, rng.integers(1, 65, 4000)), (1024, rng.integers(1, 1025, 3000)), (7, [4] * 9)):
        counts = Counter(int(x) for x in lengths)
        plan = plan_packing(counts, capacity)
        used = Counter()
        for combination, times in plan:
            assert sum(combination) <= capacity
            for k in combination:
                used[k] += times
        assert used == counts
        best, gaps = 0, []
        for x in sorted((int(x) for x in lengths), reverse=True):  # best fit decreasing
            fit_ = min((g for g in gaps if g >= x), default=None)
            if fit_ is None:
                best += 1
                gaps.append(capacity - x)
            else:
                gaps.remove(fit_)
                gaps.append(fit_ - x)
        assert sum(t for _, t in plan) <= 1.005 * best + 1
        table = runs(plan)
        assert sorted(table[:, 0].tolist()) == table[:, 0].tolist()
    assert plan_packing({}, 5) == []
    with pytest.raises(ValueError):
        plan_packing({6: 1}, 5)


# --- 10 exact dedup


@pytest.mark.parametrize("digit", [64, 3])
def test_exact_dedup(frame, corpus, nothing, digit):
    got = Counter(map(tuple, exact_dedup(frame, first_digit=digit).collect()))
    assert got == brute.equal_texts([(i, t) for i, t, _ in corpus])
    assert exact_dedup(nothing).count() == 0


def test_without_duplicates(frame, corpus, nothing):
    out = without_duplicates(frame)
    assert out.columns == frame.columns
    kept = Counter((i, sha) for i, _, _, k, sha in brute.equal_texts([(i, t) for i, t, _ in corpus]).elements() if k)
    body = F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ").cast("binary"), 256)
    assert Counter(map(tuple, out.select("doc_id", body).collect())) == kept
    assert without_duplicates(nothing).count() == 0


def test_archives_of_any_name_and_ids_of_any_text(spark, tmp_path):
    ids = ["a:b", "50%", "a b", "ü/x", "1e3", "", None, "plus+"]
    pages = spark.createDataFrame([(i, "http://x", "y" * 1200) for i in ids], "page_id string, url string, html string")
    got = {r.page: (r.type, r.refers_to, r.problem) for r in warc.round_trip(pages).collect()}
    first = max(i for i in ids if i is not None)
    assert got[first] == ("response", None, None)
    assert all(got[i] == ("revisit", first, None) for i in ids if i and i != first)
    warc.write_archives(pages.where("page_id = 'a:b'"), f"{tmp_path}/own")
    (source,) = __import__("glob").glob(f"{tmp_path}/own/part-*")
    (tmp_path / "crawl").mkdir()
    __import__("shutil").copy(source, tmp_path / "crawl" / "CRAWL-00017.warc.gz")
    assert [r.type for r in warc.read_records(spark, f"{tmp_path}/crawl").collect()] == ["response"]


def _messages(n):
    return [warc.record([("WARC-Type", "response"), ("WARC-Record-ID", f"<{i}>")], warc.http_message(bytes([65 + i]) * 3000, 700)) + warc.END for i in range(n)]


@pytest.mark.parametrize("piece", [7, 1000, 1 << 20])
@pytest.mark.parametrize("form", ["plain", "whole", "members"])
def test_archives_in_pieces(monkeypatch, piece, form):
    monkeypatch.setattr(warc, "PIECE", piece)
    records = _messages(5)
    archive = {"plain": b"".join(records), "whole": gzip.compress(b"".join(records)), "members": b"".join(map(gzip.compress, records))}[form]
    assert [warc.http_payload(c)[:1] for _, c in warc.parse(archive)] == [b"A", b"B", b"C", b"D", b"E"]


def test_broken_records_are_rows(spark, tmp_path):
    a, b, c, d, e = _messages(5)
    nameless = warc.record([("WARC-Type", "response")], b"x") + warc.END
    odd = warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<odd>"), ("WARC-Segment-Number", "one")], b"x") + warc.END
    info = warc.record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<info>")], b"software: x") + warc.END
    other = warc.record([("WARC-Type", "resource"), ("WARC-Record-ID", "<md5>"), ("WARC-Payload-Digest", "md5:00")], b"block") + warc.END
    folder = tmp_path / "crawl"
    folder.mkdir()
    (folder / "one.warc").write_bytes(b"rubbish\r\n\r\n" + a + b[:1500] + warc.END + c + nameless + info + odd + other + d.replace(b"Content-Length", b"Content-Size") + e)
    (folder / "two.warc.gz").write_bytes(gzip.compress(a.replace(b"<0>", b"<10>")) + gzip.compress(b.replace(b"<1>", b"<11>"))[:-30])
    (folder / "three").write_bytes(b"")
    rows = {(r.id, r.problem and " ".join(w for w in r.problem.split(":")[0].split() if not w.isdigit())): r.payload for r in warc.reassemble(warc.read_records(spark, str(folder))).collect()}
    sound = {k[0]: bytes(v) for k, v in rows.items() if k[1] is None}
    assert sound == {"<0>": b"A" * 3000, "<2>": b"C" * 3000, "<4>": b"E" * 3000, "<info>": b"software: x", "<md5>": b"block", "<10>": b"A" * 3000}
    assert {k for k in rows if k[1]} == {
        (None, "no record at byte"), ("<1>", "the record at byte is cut short"), (None, "the record has no id"), ("<odd>", "the record's segment is no number"),
        ("<3>", "the record at byte states no length"), ("<11>", "the record at byte is cut short"), (None, "the archive cannot be inflated behind byte")}


def test_training_against_plain_updates():
    """The learner against FTRL-proximal written out for one coordinate after another."""
    s = Settings(bits=6, epochs=3)
    random = np.random.default_rng(5)
    texts = [random.integers(0, 64, size) for size in (0, 1, 7, 30, 30, 200)]
    labels = [0, 1, 1, 0, 1, 0]
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= s.l1:
            return 0.0
        return -(z[i] - (s.l1 if z[i] > 0 else -s.l1)) / ((s.beta + n[i] ** 0.5) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for text, label in zip(texts, labels, strict=True):
            x = {i: c * s.scale / len(text) for i, c in Counter(text.tolist()).items()} | {64: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-sum(w[i] * x[i] for i in x)))
            for i in x:
                g = (p - label) * x[i]
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / s.alpha * w[i]
                n[i] += g * g
    got = classifier.train(iter(texts), np.array(labels), s)
    assert np.count_nonzero(got) > 10
    np.testing.assert_allclose(got, [weight(i) for i in range(65)], rtol=1e-4, atol=1e-6)
