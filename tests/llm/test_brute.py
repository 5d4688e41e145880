"""Operators of the subpackage against brute force, on small fixtures with nulls, ties, repeats and clashing columns."""

import base64
import itertools
import math
import random
import re

import duckdb
import numpy as np
import pytest
import regex
import tiktoken

from lodestar.llm import chat, decontaminate, jaccard, langid, linededup, lmscore, mixing, mtree, repeats, tokencount

DOCS = "doc_id long, text string, lang string, source string, n_chars long, token string, id string, size int"


def docs_of(spark, texts, source="s", lang="en"):
    """Documents 0, 1, ... with columns whose names the operators use inside."""
    rows = [(i, t, lang, source, len(t) if t is not None else None, "x", "y", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# 1


def test_mixing_is_that_of_sql(spark):
    rng = random.Random(1)
    texts = [None, "", *(sentence(rng, rng.randrange(1, 60)) for _ in range(120))]
    docs = docs_of(spark, texts).drop("source").selectExpr("*", "CASE doc_id % 5 WHEN 0 THEN null WHEN 1 THEN 'b' ELSE 'hot' END AS source")
    got = mixing.mix_sources(docs, block_tokens=40, shards=3)
    arrow = docs.select("doc_id", "text", "source").toArrow()
    con = duckdb.connect()
    con.register("documents", arrow)
    want = con.execute(mixing.oracle(block_tokens=40, shards=3)).fetchall()
    assert rows(got) == sorted(want)
    assert got.count() and mixing.mix_sources(docs.limit(0)).count() == 0


def test_quotas_follow_highest_quotients():
    weights, blocks, shards = {"a": 5, "b": 3, "c": 3}, {"a": 9, "b": 4, "c": 7}, 2
    seats = sorted((-weights[s] / (2 * k + 1), s, k) for s in weights for k in range(blocks[s] + 1))
    house = next(i for i, (_, s, k) in enumerate(seats) if k == blocks[s])
    per = house // shards
    want = {s: [sum(1 for x in seats[: per * (i + 1)] if x[1] == s) for i in range(shards)] for s in weights}
    assert mixing.quotas(weights, blocks, shards) == want
    assert mixing.quotas({}, {}, 2) == {} and mixing.quotas({"a": 0}, {"a": 3}, 1) == {}


# 2


def test_lines(spark, monkeypatch):
    rng = random.Random(2)
    base = [sentence(rng, 12) for _ in range(40)]

    def near(line):
        parts = line.split()
        for _ in range(rng.randrange(0, 3)):
            parts[rng.randrange(len(parts))] = f"w{rng.randrange(400)}"
        return " ".join(parts)

    texts = [None, "", "\n\n", "one\nONE!\ntwo"] + ["\n".join(near(rng.choice(base)) for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    docs = docs_of(spark, texts)
    lines = [(d, i, frozenset(words(x))) for d, t in enumerate(texts) if t is not None for i, x in enumerate(t.split("\n"))]
    want = {}
    for n, (d, i, own) in enumerate(lines):
        for e, j, other in lines[:n]:
            if own and other and len(own & other) / len(own | other) >= 0.8 - 1e-12:
                want[d, i] = (e, j, len(own & other) / len(own | other))
                break
    got = {(r.doc_id, r.line): (r.match_doc_id, r.match_line, pytest.approx(r.jaccard)) for r in linededup.later_lines(docs).collect()}
    assert got == want and want
    monkeypatch.setattr(linededup, "blocks_of", lambda counts: np.minimum(np.ceil(counts / 40), linededup.BLOCKS).astype(np.int64))
    monkeypatch.setattr(linededup, "GROWTH", 2)
    again = {(r.doc_id, r.line): (r.match_doc_id, r.match_line, pytest.approx(r.jaccard)) for r in linededup.later_lines(docs).collect()}
    assert again == want
    left = {r.doc_id: r for r in linededup.remove_later_lines(docs).collect()}
    assert left[0].text is None and left[1].text == "" and left[3].text == "one\ntwo" and left[3].n_chars == 7
    for d, t in enumerate(texts[4:], 4):
        kept = [x for i, x in enumerate(t.split("\n")) if (d, i) not in want]
        assert (left[d].text == "\n".join(kept)) if any(words(x) for x in kept) else d not in left
    assert linededup.remove_later_lines(docs).columns == docs.columns
    assert linededup.later_lines(docs.limit(0)).count() == 0


# 3


def brute_nearest(vectors, k):
    out = []
    for i, v in vectors.items():
        d = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(v, w, strict=True))), j) for j, w in vectors.items() if j != i and len(w) == len(v))
        out += [(i, n, j, round(x, 6)) for n, (x, j) in enumerate(d[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("shape", ["clusters", "random"])
def test_nearest(spark, shape):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(260, 6))
    if shape == "clusters":
        x = x[rng.integers(0, 8, 260)] + 0.05 * x
    x[40:90] = x[40]  # copies, more than a page
    vectors = {i: np.float32(v).tolist() for i, v in enumerate(x)} | {900: [1.0, 2.0], 901: [1.0, 3.0]}
    table = [(i, v, 1, "x") for i, v in vectors.items()]
    table += [table[5], (None, [1.0] * 6, 1, "x"), (500, None, 1, "x"), (501, [float("nan")] * 6, 1, "x"), (502, [None] * 6, 1, "x"), (503, [], 1, "x")]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, label int, id string")
    got = mtree.nearest(df, k=5, subtree_rows=40, page_rows=16)
    assert sorted((r.vec_id, r.rank, r.neighbour_id, round(r.distance, 6)) for r in got.collect()) == brute_nearest(vectors, 5)
    some = mtree.nearest(df, k=5, query_step=7, subtree_rows=2, page_rows=4)  # many subtrees for the copies
    assert sorted((r.vec_id, r.rank, r.neighbour_id, round(r.distance, 6)) for r in some.collect()) == [r for r in brute_nearest(vectors, 5) if r[0] % 7 == 0]
    assert mtree.nearest(df.limit(0)).count() == 0


def test_bounds_save_distances():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20, 4))[rng.integers(0, 20, 2000)] + 0.01 * rng.normal(size=(2000, 4))
    pivot = x[0]
    tree = mtree.Tree(*mtree.build_pages(np.arange(2000), x, pivot, 64))
    assert 1 < len(tree.inner) < len(tree.pages)
    row, _, d = tree.search(np.arange(2000), x, mtree.exact(x, pivot[None]), np.full(2000, np.inf), 5)
    assert len(row) == 10000 and tree.measured < 0.4 * 2000 * 2000
    want = np.sort(np.sqrt(((x[:50, None] - x[None]) ** 2).sum(-1)), axis=1)[:, 1:6]
    assert np.allclose(d.reshape(2000, 5)[:50], want)


# 4


def test_scores(spark):
    rng = random.Random(5)
    texts = [None, "", "lonely", *(sentence(rng, rng.randrange(1, 80), 60) for _ in range(80))]
    docs = docs_of(spark, texts)
    uni, bi = {}, {}
    for t in texts:
        w = words(t)
        for a in w:
            uni[a] = uni.get(a, 0) + 1
        for p in itertools.pairwise(w):
            bi[p] = bi.get(p, 0) + 1
    read = lambda n: float(lmscore.count_of(lmscore.level_of(np.array([n])))[0]) if n else 0.0
    tokens, kinds = sum(uni.values()), len(uni) + len(bi)
    for limit in (1 << 26, 0):
        model = lmscore.train(docs, broadcast_bytes=limit)
        assert (model.tokens, model.vocabulary, model.bits is None) == (tokens, kinds, limit == 0)
        got = {r.doc_id: r for r in lmscore.score(docs, model).collect()}
        assert len(got) == len(texts) and got[0].perplexity is None and got[1].n_words == 0
        off = []
        for i, t in enumerate(texts):
            w, total = words(t), 0.0
            for n, a in enumerate(w):
                p = (read(uni[a]) + 0.5) / (tokens + 0.5 * kinds)
                if n:
                    p = 0.6 * min(1.0, read(bi[w[n - 1], a]) / read(uni[w[n - 1]])) + 0.4 * p
                total += math.log(p)
            off.append(abs(got[i].log_prob - total))
        # a false positive, some one in a hundred reads, doubles a count
        assert sum(off) <= 0.03 * tokens and min(off) < 1e-9
    assert lmscore.score(docs.limit(0), model).count() == 0


def test_filter_never_reads_too_low():
    rng = np.random.default_rng(6)
    hashes = rng.integers(0, 1 << 63, 20000).astype(np.uint64)
    counts = rng.integers(1, 300, 20000)
    level = lmscore.probe(lmscore.build_filter(hashes, counts), hashes)
    assert (level >= lmscore.level_of(counts)).all() and (level == lmscore.level_of(counts)).mean() > 0.97
    absent = lmscore.probe(lmscore.build_filter(hashes, counts), rng.integers(0, 1 << 63, 20000).astype(np.uint64))
    assert (absent == 0).mean() > 0.97


# 5


def test_contamination(spark):
    rng = random.Random(7)
    items = [sentence(rng, n) for n in (30, 8, 25, 3, 12)] + [None]
    texts = [None, "", sentence(rng, 100)]
    for item in items[:-1]:
        texts.append(f"{sentence(rng, 20)} {item} {sentence(rng, 9)}")
    w = items[0].split()
    texts += [" ".join([*w[:9], "x", "y"]), " ".join([*w[3:14], "z"]), " ".join(w[:5]), items[2].upper().replace(" ", ",  "), " ".join([*items[1].split()[:6], "q"])]
    docs = docs_of(spark, texts)
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id long, text string, doc_id string")
    got = {r.doc_id: r for r in decontaminate.contaminated(docs, benchmark).collect()}
    want = {}
    for d, t in enumerate(texts):
        own, runs = words(t), []
        for a in range(len(own)):
            for b in range(len(own), a + 5, -1):
                hit = {i for i, x in enumerate(items) if len(words(x)) >= 6 and f" {' '.join(own[a:b])} " in f" {' '.join(words(x))} "}
                if hit:
                    if not any(p <= a and b <= q for p, q, _ in runs):
                        runs.append((a, b, hit))
                    break
        covered = {}
        for a, b, hit in runs:
            for i in hit:
                covered.setdefault(i, set()).update(range(a, b))
        full = {i for i, c in covered.items() if len(c) >= 0.5 * len(words(items[i]))}
        gone = [(a, b) for a, b, hit in runs if b - a >= 10 or hit & full]
        if gone:
            want[d] = (len(gone), len(set().union(*(range(a, b) for a, b in gone))), max(b - a for a, b in gone))
    assert {d: (r.runs, r.removed_words, r.longest_run) for d, r in got.items()} == want and len(want) >= 6
    assert rows(decontaminate.contaminated(docs, benchmark, max_words=20).select("doc_id", "runs")) == rows(decontaminate.contaminated(docs, benchmark).select("doc_id", "runs"))
    left = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, benchmark).collect()}
    assert left[0] is None and left[1] == "" and left[2] == texts[2]
    assert all(left.get(d, "") == (got[d].text if d in got else t) or not words(got[d].text) for d, t in enumerate(texts))
    assert decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0 and decontaminate.contaminated(docs.limit(0), benchmark).count() == 0


# 6


def fold(events):
    """The conversations of a log, event by event."""
    out = {}
    order = sorted({e for e in events if e[0] is not None and e[1] is not None}, key=lambda e: (e[0], e[2], e[1], chat.KINDS.index(e[3]) if e[3] in chat.KINDS else 9, e[4] is not None, e[4] or "", e[5] or ""))
    for conv, turn, _, kind, role, text in order:
        own = out.setdefault(conv, {})
        text = text or ""
        if kind in ("edit", "regenerate"):
            for later in [t for t in own if t > turn]:
                del own[later]
        if kind in ("message", "edit", "regenerate"):
            own[turn] = [(role, text)]
        elif kind == "delta":
            own.setdefault(turn, []).append((role, text))
        elif kind == "delete":
            own.pop(turn, None)
    show = lambda s: s.replace("<|", "< |")
    return {c: "".join(f"{chat.OPEN}{show(next((r for r, _ in m[t] if r), chat.DEFAULT_ROLE))}\n{show(''.join(x for _, x in m[t]))}{chat.CLOSE}\n" for t in sorted(m)) for c, m in out.items()}


def test_chats(spark):
    rng = random.Random(8)
    events = []
    for conv in range(30):
        for seq in range(rng.randrange(1, 25)):
            events.append((conv, rng.randrange(4), rng.choice([seq, seq, 3]), rng.choice([*chat.KINDS, "delta", "delta", "other"]), rng.choice(["user", "assistant", None]), rng.choice(["a ", "b<|x|>", "", None, f"t{seq} "])))
    events += [events[0], (None, 1, 1, "message", "user", "x"), (99, None, 1, "message", "user", "x"), (77, 1, 1, "other", "user", "x")]
    log = spark.createDataFrame([(*e, "clash", 1) for e in events], "conv_id long, turn long, seq long, kind string, role string, text string, at string, live int")
    got = chat.format_chats(log)
    assert {r.conv_id: r.chat for r in got.collect()} == fold(events)
    con = duckdb.connect()
    con.register("log", log.select("conv_id", "turn", "seq", "kind", "role", "text").toArrow())
    assert rows(got) == sorted(con.execute(chat.oracle("log", "kind", "seq")).fetchall())
    assert sum(r.n_events for r in got.collect()) == len(events) - 2
    plain = chat.format_chats(spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", "a")], "conv_id long, turn long, role string, text string")).first()
    assert plain.chat == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n" and plain.n_dead == 0
    assert chat.format_chats(log.limit(0)).count() == 0


# 7

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def test_token_counts_are_those_of_the_library(spark):
    rng = random.Random(9)
    bits = ["'", "s", "t", "re", "ve", "ll", "d", " ", "  ", "\n", "\t", "a", "B", "é", "中", "1", "½", ".", "!!", "　", "😀", "\x85", "\x1c", "the ", "_", "<|endoftext|>"]
    texts = [None, "", "a" * 3000, "ab" * 2000, " " * 50, "".join(rng.choice("abcdefgh") for _ in range(6000))] + ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(1500)]
    with open(tokencount.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = docs_of(spark, texts)
    got = {r.doc_id: r for r in tokencount.token_counts(docs).collect()}
    assert [got[i].n_tokens for i in range(len(texts))] == [len(encoding.encode_ordinary(t or "")) for t in texts]
    assert [got[i].n_pretokens for i in range(len(texts))] == [len(regex.findall(PATTERN, t or "")) for t in texts]
    assert got[0].n_bytes == 0 and tokencount.token_counts(docs.limit(0)).count() == 0


# 8


def test_passages(spark, monkeypatch):
    rng = random.Random(10)
    passage, other = sentence(rng, 70), sentence(rng, 52)
    texts = [None, "", sentence(rng, 49), sentence(rng, 200)]
    texts += [f"{sentence(rng, 30)} {passage} {sentence(rng, 12)}" for _ in range(3)] + [passage.upper(), " ".join(passage.split()[:55]), f"{other} {sentence(rng, 60)}", f"{sentence(rng, 3)} {other}", f"{passage} {sentence(rng, 5)}"]
    twice = sentence(rng, 60)
    texts += [f"{twice} {sentence(rng, 5)} {twice}", " ".join(["same"] * 120), " ".join(["same"] * 60), sentence(rng, 80)]
    docs = docs_of(spark, texts)
    at = {}
    for d, t in enumerate(texts):
        own = words(t)
        for i in range(len(own) - 49):
            at.setdefault(tuple(own[i : i + 50]), []).append((d, i))
    for hot, within in itertools.product((repeats.HOT_PLACES, 3, 0), (True, False)):
        several = [p for p in at.values() if len(p if within else {d for d, _ in p}) > 1]
        want, later = {}, {}
        for places in several:
            for d, i in places:
                want.setdefault(d, set()).update(range(i, i + 50))
                if (d, i) != min(places):
                    later.setdefault(d, set()).update(range(i, i + 50))
        monkeypatch.setattr(repeats, "HOT_PLACES", hot)
        got, removed = {}, {}
        for r in repeats.repeated_passages(docs, within=within).collect():
            assert r.words == r.end_word - r.start_word >= 50
            got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
            if r.later:
                removed.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
        assert got == want and removed == later and len(want) >= 8
    assert repeats.repeated_passages(docs.limit(0)).count() == 0


# 9


def test_languages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    train, held = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1 AND n_chars > 100")
    model = langid.train(train)
    got = {r.doc_id: r for r in langid.identify(held, model).collect()}
    want = {r.doc_id: r.lang for r in held.collect()}
    assert sum(got[i].detected == lang for i, lang in want.items()) >= 0.93 * len(want)
    odd = docs_of(spark, [None, "", "12 34 !!", "Ж" * 200 + " щюя " * 50, "字" * 300])
    assert [r.accepted for r in langid.identify(odd, model).orderBy("doc_id").collect()] == [False] * 5
    assert langid.accept(odd, model).count() == 0 and langid.accept(docs, model).columns == docs.columns
    assert langid.identify(docs.limit(0), model).count() == 0
    empty = langid.train(docs.limit(0))
    assert {r.detected for r in langid.identify(held, empty).collect()} == {langid.UNKNOWN}


# 10


def grams(text, n=3):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def test_near_documents(spark):
    rng = random.Random(11)
    base = [sentence(rng, 60) for _ in range(25)]
    texts = [None, "", "a b", "A, b!"]
    for b in base:
        for edits in (0, 0, 2, 4, 7):
            w = b.split()
            for _ in range(edits):
                w[rng.randrange(len(w))] = f"v{rng.randrange(99)}"
            texts.append(" ".join(w))
    docs = docs_of(spark, texts)
    sets = {i: grams(t) for i, t in enumerate(texts) if grams(t)}
    want = {(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    members, verified = jaccard.near_groups(docs)
    rep = {r.doc_id: r.rep for r in members.collect()}
    assert rep == {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    near = {(r.a, r.b): r.jaccard for r in verified.collect()}
    for (a, b), found in near.items():
        assert found == pytest.approx(len(sets[a] & sets[b]) / len(sets[a] | sets[b])) and found >= 0.5
    got = {(a, b) for a, b in itertools.combinations(sets, 2) if rep[a] == rep[b] or tuple(sorted((rep[a], rep[b]))) in near}
    exact = {(a, b) for a, b in want if sets[a] == sets[b]}
    assert got <= want and exact <= got and len(got) >= 0.95 * len(want)
    root = {i: i for i in sets}
    for _ in sets:
        for a, b in got:
            root[a] = root[b] = min(root[a], root[b])
    links = {i: sum(i in p for p in got) for i in sets}
    assert rows(jaccard.jaccard_join(docs)) == sorted((i, root[i], sum(sets[j] == sets[i] for j in sets) - 1, links[i]) for i in sets if links[i])
    kept = {r.doc_id for r in jaccard.keep_one(docs).collect()}
    assert {0, 1, 2} <= kept and 3 not in kept
    assert all(any(i in kept for i in group) for group in [range(4 + 5 * n, 9 + 5 * n) for n in range(25)])
    assert not any(a in kept and b in kept for a, b in got)
    assert jaccard.jaccard_join(docs.limit(0)).count() == 0 and jaccard.keep_one(docs.limit(0)).count() == 0


def test_components(spark):
    pairs = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r.node: r.root for r in jaccard.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {n: r for n, r in got.items() if n < 100} == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 20: 20, 21: 20}
    assert {r for n, r in got.items() if n >= 100} == {100}
