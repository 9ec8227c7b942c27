"""Operators over whole tables: brute force, invariants, odd inputs."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from arterial.llm import covertree, mixing, mixlm, neardup, sharding, spelling

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- mixing ---------------------------------------------------------------------------


def fill(sizes, weights, most):
    """Water-filling by repeated clamping."""
    total, open_, out = sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    rest = float(total)
    while open_:
        share = {k: rest * weights[k] / sum(weights[j] for j in open_) for k in open_}
        over = {k for k in open_ if share[k] > most * sizes[k]}
        if not over:
            for k in open_:
                out[k] = share[k]
            break
        for k in over:
            out[k] = most * sizes[k]
            rest -= out[k]
        open_ -= over
    return out


def test_mix_reaches_targets(docs_of, odd):
    rng = np.random.default_rng(6)
    texts = [*odd, *(" ".join(["w"] * int(n)) for n in rng.integers(1, 80, 300))]
    docs = docs_of(texts, target=1.0).withColumn("source", F.expr("CASE WHEN doc_id % 97 = 0 THEN 'a' WHEN doc_id % 11 = 0 THEN NULL ELSE source END"))
    rows = mixing.mix_to_targets(docs).collect()
    assert len(rows) == len(texts) and {r.doc_id: r.size for r in rows} == {k: len(WORD.findall(t or "")) for k, t in enumerate(texts)}
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(r.size for r in by[s]) for s in order]
    want = fill(sizes, [(5, 2, 1)[k % 3] for k in range(len(order))], 3)
    for s, size, target in zip(order, sizes, want, strict=True):
        assert {(r.source_size, round(r.target, 6)) for r in by[s]} == {(size, round(target, 6))}
        assert abs(sum(r.taken for r in by[s]) - target) <= 0.5 * len(by[s]) ** 0.5 + 2
        assert all(0 <= r.taken <= 3 * r.size for r in by[s])
    again = mixing.mix_to_targets(docs.repartition(3)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in rows)


def test_mix_of_whole_documents(docs_of):
    rng = np.random.default_rng(5)
    texts = ["w " * int(n) for n in rng.integers(1, 60, 300)] + ["", None, "w " * 5000]
    docs = docs_of(texts)
    rows = mixing.mix_to_targets(docs, whole=True).collect()
    by_source = {}
    for r in rows:
        assert r.size == len((r.text or "").split()) and (r.taken % r.size == 0 if r.size else r.taken == 0) and r.taken <= 3 * r.size
        got = by_source.setdefault(r.source, [0, r.target, 0])
        got[0] += r.taken
        got[2] = max(got[2], r.size)
    # The document at the cut is taken or left whole: half of it is the most that words can miss.
    assert all(abs(a - b) <= most / 2 + 1 for a, b, most in by_source.values())
    again = mixing.mix_to_targets(docs.repartition(5), whole=True).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    assert mixing.mix_to_targets(docs_of([]), whole=True).count() == 0


def test_mix_of_nothing(docs_of):
    assert mixing.mix_to_targets(docs_of([])).count() == 0
    assert [r.taken for r in mixing.mix_to_targets(docs_of([None, ""])).collect()] == [0, 0]


# -- sharding -------------------------------------------------------------------------


@pytest.mark.parametrize("hot", [False, True])
def test_shards_are_even_and_slots_gapless(docs_of, odd, hot):
    rng = np.random.default_rng(9)
    texts = [*odd[:7], *("z" * int(n) + str(k) for k, n in enumerate(rng.integers(0, 60, 900)))] + ["the same text"] * (500 if hot else 0)
    rows = sharding.histogram_shards(docs_of(texts, slot=1), 24).collect()
    assert len(rows) == len(texts)
    size, slots, of_text = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        t = texts[r.doc_id]
        assert r.size == len((t or "").encode()) + 8 and r.text_crc32 == (None if t is None else zlib.crc32(t.encode()))
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        of_text[t].add(r.shard)
    mean = sum(size.values()) / 24
    assert set(size) == set(range(24)) and max(abs(v - mean) for v in size.values()) <= 2 * 90
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    if not hot:
        assert all(len(v) == 1 for v in of_text.values())


def test_fine_ranges_give_the_same_shards(docs_of, monkeypatch):
    docs = docs_of([f"text {k % 170}" for k in range(600)])
    plain = {r.doc_id: r.shard for r in sharding.histogram_shards(docs, 4).collect()}
    monkeypatch.setattr(sharding, "RANGE_ROWS", 20)
    rows = sharding.histogram_shards(docs, 4).collect()
    assert {r.doc_id: r.shard for r in rows} == plain
    for s in range(4):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))


def test_no_rows_no_shards(docs_of):
    assert sharding.histogram_shards(docs_of([]), 24).count() == 0


# -- top k ----------------------------------------------------------------------------


def brute_top(rows, k=5, every=50):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in {i for i, _ in good if i % every == 0}:
        found = [(-sum(a * b for a, b in zip(x, y, strict=True)), i) for j, x in good if j == q for i, y in good if i != q and len(x) == len(y)]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def test_top_k_is_exact(spark, monkeypatch):
    rng = np.random.default_rng(12)
    centres = rng.normal(0, 1, (6, 8))
    rows = [(k, [float(x) for x in np.float32(centres[k % 6] + rng.normal(0, 0.1, 8))]) for k in range(700)]
    rows += [(k, rows[k][1]) for k in range(0, 700, 9)] + [(900, None), (950, [1.0, None]), (1000, [float("nan")] * 8), (None, [1.0] * 8), (1050, []), (1100, [2.0, 3.0]), (1101, [1.0, 1.0])]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int")
    for block, chunk in ((4096, 16384), (64, 5)):
        monkeypatch.setattr(covertree, "BLOCK", block)
        monkeypatch.setattr(covertree, "CHUNK", chunk)
        got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in covertree.top_k_products(table).collect())
        assert got == brute_top(rows)
    assert covertree.top_k_products(table.limit(0)).count() == 0


def test_large_components(spark):
    rows = [(0, [1e16, 3.0]), (1, [1e16, 5.0]), (2, [-1e16, 5.0])]
    got = [(r.vec_id, r.score) for r in covertree.top_k_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()]
    assert got == [(1, (1 << 63) - 1), (2, -(1 << 63))]


def test_tree_covers(monkeypatch):
    x = np.random.default_rng(1).normal(0, 1, (500, 5))
    tree = covertree.CoverTree(x)
    assert sorted(tree.order) == list(range(500))

    def below(n):
        if tree.last[n] == tree.first[n]:
            return tree.order[tree.start[n] : tree.stop[n]]
        return np.concatenate([below(c) for c in range(tree.first[n], tree.last[n])])

    for n in range(len(tree.centre)):
        assert np.linalg.norm(x[below(n)] - x[tree.centre[n]], axis=1).max() <= tree.radius[n] + 1e-9


# -- near duplicates ------------------------------------------------------------------


def brute_components(texts, ids, width, percent):
    sets = []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(texts)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y, key=lambda k: ids[k])] = min(x, y, key=lambda k: ids[k])
    return {ids[k]: (len(sets[k]), ids[find(k)]) for k in range(len(texts))}


def test_near_duplicates_against_brute_force(docs_of, odd):
    rng = np.random.default_rng(21)
    words = [f"w{k}" for k in range(500)]
    texts = list(odd)
    for _ in range(12):  # families around the threshold, and chains
        base = list(rng.choice(words, 80))
        for _ in range(8):
            copy = list(base)
            for at in rng.integers(0, 80, rng.integers(0, 5)):
                copy[at] = str(rng.choice(words))
            texts.append(" ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
            base = copy if rng.random() < 0.5 else base
    texts += texts[20:30]
    ids = [int(x) for x in rng.permutation(5000)[: len(texts)]]
    rows = neardup.near_duplicates(docs_of(texts, ids), 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(texts, ids, 3, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_a_large_family_in_rounds(docs_of, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL_BUCKET", 3)
    rng = np.random.default_rng(5)
    base, texts = [f"w{k}" for k in range(60)], []
    for k in range(90):
        copy = list(base)
        for at in rng.integers(0, 60, rng.integers(0, 6)):
            copy[at] = f"x{k}-{at}"
        texts.append(" ".join(copy))
    rows = neardup.near_duplicates(docs_of(texts), 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(texts, list(range(90)), 3, 85)


def test_five_words_at_eighty_percent(docs_of):
    rng = np.random.default_rng(15)
    texts = []
    for family in range(6):
        base = [f"f{family}w{k}" for k in range(int(rng.integers(40, 120)))]
        for k in range(14):
            copy = list(base)
            for at in rng.integers(0, len(base), rng.integers(0, 4)):
                copy[at] = f"x{family}-{k}-{at}"
            texts.append(" ".join(copy))
    texts += [texts[0], "one two three four", "one two three four", "one two three", None, ""]
    rows = neardup.near_duplicates(docs_of(texts), 5, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(texts, list(range(len(texts))), 5, 80)


def test_bands_follow_the_similarity():
    assert neardup.banding(85) == (6, 28) and neardup.banding(80) == (5, 34)
    for percent in (50, 60, 70, 80, 85, 90, 95):
        rows, bands = neardup.banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= neardup.MISS and rows * bands <= neardup.VALUES
    a, b = (neardup.shingle_hashes(" ".join(f"w{k}" for k in r), 3) for r in (range(100), range(4, 104)))
    differ = int(np.bitwise_count(neardup.parity_sketch(a).view(np.uint64) ^ neardup.parity_sketch(b).view(np.uint64)).sum())
    assert 0 < differ <= len(np.setxor1d(a, b))


def test_ids_of_several_texts_tie_them(docs_of):
    rows = neardup.near_duplicates(docs_of(["a b c d", "x y z q", "a b c d", "x y z q"], [3, 5, 7, 7])).collect()
    assert {(r.doc_id, r.component_id) for r in rows} == {(3, 3), (5, 3), (7, 3)}


def test_near_duplicates_of_odd_ids(docs_of):
    rows = neardup.near_duplicates(docs_of(["a b c d", "a b c d", "a b c d", "x y z q"], [5, None, 5, 7])).collect()
    assert sorted((r.doc_id or -1, r.component_id, r.kept) for r in rows if r.doc_id) == [(5, 5, True), (5, 5, True), (7, 7, True)]
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]
    assert neardup.near_duplicates(docs_of([])).count() == 0


# -- language model -------------------------------------------------------------------


def test_word_probabilities_add_up():
    """Over all continuations of a context the coded bits are a distribution."""
    words = [b"the", b"then", b"other", b"a", b""]
    table = np.zeros((spelling.PREDICTORS, 2, 1 << spelling.TABLE_BITS), np.float32)
    spelling.count_bits(words, table)
    w, used, refine = spelling.learn_weights(words, table)
    model = spelling.BitModel(spelling.log_odds(table[:, 0], table[:, 1]), w, (refine[..., 1] + 1) / (refine.sum(-1) + 2))
    singles = [bytes([b]) for b in range(256) if b != spelling.END_WORD]
    data, place, word = spelling.flat_words([b"th" + s for s in singles])
    lp = spelling.score_words([b"th" + s for s in singles], model)
    ends = spelling.score_words([b"th"], model)[0]
    prefix = 10 ** spelling.score_words([b"th"], model)[0]
    assert prefix > 0 and len(data) == 4 * len(singles) and ends < 0
    assert (10**lp).sum() + prefix <= 1 + 1e-9
    assert lp[singles.index(b"e")] > lp[singles.index(b"q")]


def test_weights_are_carried_on():
    rng = np.random.default_rng(6)
    words = [bytes(rng.choice(list(b"aeinrst"), 29).tolist()) for _ in range(400)]  # 100 words an update
    table = np.zeros((spelling.PREDICTORS, 2, 1 << spelling.TABLE_BITS), np.float32)
    spelling.count_bits(words, table)
    whole = spelling.learn_weights(words, table)[0]
    learner = spelling.Learner(np.tile(spelling.START, (spelling.GATES, 1)))
    for k in (0, 200):
        spelling.learn_weights(words[k : k + 200], table, learner)
    assert np.array_equal(learner.weights, whole) and learner.steps == 32


def test_mix_scores_columns(docs_of, odd):
    rng = np.random.default_rng(3)
    texts = [*odd, *(" ".join(rng.choice(["The", "of", "and", "word", "rare" + str(k)], 30)) for k in range(60))]
    rows = mixlm.mix_scores(docs_of(texts)).collect()
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    held = {k for k in range(len(texts)) if zlib.crc32(str(k).encode()) % 5 == 1}
    c = Counter(w for k, t in enumerate(texts) if k not in held for w in WORD.findall(low(t)))
    ends = len(texts) - len(held)
    n, v = sum(c.values()) + ends, len(c) + 1
    assert len(rows) == len(texts)
    for r in rows:
        words = WORD.findall(low(texts[r.doc_id]))
        base = sum(math.log10((x + 0.5) / (n + 0.5 * (v + 1))) for x in [*(c[w] for w in words), ends])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id in held, len(words) + 1, sum(c[w] > 0 for w in words) + 1, n)
        assert r.base_score == pytest.approx(base) and r.score < 0
    by = {r.doc_id: r for r in rows}
    assert by[4].score == pytest.approx(by[5].score) and by[0].score == pytest.approx(by[1].score)
    assert mixlm.mix_scores(docs_of([])).count() == 0


# -- pipeline -------------------------------------------------------------------------


def test_pipeline_keeps_other_words_of_an_id(spark, docs_of):
    import corpus_pipeline as cp

    texts = ["one two three four five six", "ONE two  three four five six", "seven eight nine ten eleven twelve", None, "", "one two three four five six"]
    docs = docs_of(texts, [4, 4, 4, 4, 4, 9]).select(*cp.COLUMNS)
    left = sorted((r.doc_id, r.text or "") for r in cp.drop_near_duplicates(spark, docs, "").collect())
    assert left == sorted([(4, "ONE two  three four five six"), (4, "seven eight nine ten eleven twelve"), (4, ""), (4, "")])


def test_pipeline_stages(spark, docs_of, tmp_path):
    import corpus_pipeline as cp

    rng = np.random.default_rng(4)
    plain = [" ".join("".join(rng.choice(list("aeiourstln"), rng.integers(3, 9))) for _ in range(40)) for _ in range(120)]
    texts = [*plain, *plain[:10], *(t + " grumblewort fizzlehead grumblewort" for t in plain[60:100]), None, "", 'x token = "abcdefgh" y']
    docs = docs_of(texts).select(*cp.COLUMNS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    toxic = range(130, 170)
    spark.createDataFrame([(k, 1, int(k in toxic)) for k in range(170)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d, now = str(tmp_path), docs
    left = cp.drop_toxic(spark, now, d)
    assert {r.doc_id for r in left.collect()} >= {*range(120), 170, 171, 172} and left.count() < 150
    left = cp.drop_near_duplicates(spark, left.cache(), d)
    assert not {r.doc_id for r in left.collect()} & set(range(120, 130))
    left = cp.redact_secrets(spark, left.cache(), d)
    assert left.where("doc_id = 172").first().text == 'x [secret]" y' and tuple(left.columns) == cp.COLUMNS
    sizes = {r.doc_id: len(WORD.findall(r.text or "")) for r in left.cache().collect()}
    mixed = cp.mix_sources(spark, left, d)
    taken, by_source, inside = Counter(), Counter(), {(r.doc_id, r.text) for r in left.collect()}
    for r in mixed.collect():
        assert (r.doc_id, r.text) in inside  # whole documents alone
        taken[r.doc_id] += len(WORD.findall(r.text))
        by_source[r.source] += len(WORD.findall(r.text))
    assert all(n <= 3 * sizes[k] for k, n in taken.items())
    wanted = {r.source: r.target for r in mixing.mix_to_targets(left).collect()}
    assert all(abs(by_source[k] - v) <= max(sizes.values()) for k, v in wanted.items())
    assert cp.run(spark, d).count() == mixed.count()
    assert {c for _, f in cp.STAGES[:-1] for c in f(spark, docs.limit(0), d).columns} == set(cp.COLUMNS)
