"""Texts of a megabyte that are made to be slow, empty tables, and layouts."""

import time
import zlib

import numpy as np
import pytest

from arterial.llm import neardup, pieces, rules, secretscan, surrogates, toxicity

N = 500_000
HARD = {
    "leaders": ". " * N, "hyphens": "a-" * N + " :", "dots": "a." * N + " :", "one word": "x" * (2 * N), "no blanks": "Ab1/" * (N // 2), "quotes": 'a="' * (N // 2), "signs": "a=" * N, "names": "Dr. Aa " * (N // 4),
    "ids": "user " * (N // 3), "gap": "secret" + " " * N, "breaks": "\n " * N, "digits": "1-" * N, "at": "a@" * N, "capitals": "Aa " * (N // 2), "singles": "a " * N + "b!",
}


@pytest.mark.parametrize("name", HARD)
def test_a_megabyte_is_read_in_time(name):
    text = HARD[name]
    for read in (toxicity.units, lambda t: secretscan.linked_spans(t, secretscan.base_spans(t)), rules.text_stats, surrogates.find_entities, lambda t: neardup.shingle_hashes(t, 3)):
        began = time.perf_counter()
        read(text)
        assert time.perf_counter() - began < 2


def test_spaced_out_words():
    plain = "see i d i o t here. a b, c d e f. x . . . y . . . . \ta b c\n1 2 3 4"
    assert toxicity.spaced_out(plain) == ["idiot", "cdef", "x...y", "abc", "1234"]
    assert toxicity.spaced_out(". " * 10) == [] and toxicity.spaced_out("a b") == []


def test_rules_under_another_layout(spark, docs_of):
    rng = np.random.default_rng(9)
    texts = [" ".join(rng.choice(["word", "other", "#", "!", "Long", "text,", "more", "lines\n"], int(rng.integers(10, 120)), p=p / p.sum())) for p in (rng.uniform(0.1, 1, 8) for _ in range(400))]
    bad = [int(100 * t.count("#") > 4 * len("".join(t.split()))) for t in texts]
    docs = docs_of(texts)
    labels = spark.createDataFrame([(k, 1 - b, 0) for k, b in enumerate(bad)], "doc_id long, quality int, toxic int")
    found = [rules.fit_quality_rules(d, lab) for d, lab in ((docs, labels), (docs.repartition(7), labels.repartition(3)), (docs.orderBy("doc_id", ascending=False), labels))]
    assert found[0] and found[0] == found[1] == found[2]
    verdict = {r.doc_id: r.rule > 0 for r in rules.apply_rules(docs, found[0]).collect()}
    assert np.mean([verdict[k] == bool(b) for k, b in enumerate(bad)]) > 0.9


def test_empty_tables(spark, docs_of):
    none = docs_of([])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert surrogates.replace_entities(none, "k").count() == 0 and secretscan.scan_secrets(none).count() == 0
    assert toxicity.score_toxicity(none, toxicity.fit_toxicity(none, labels)).count() == 0
    assert rules.apply_rules(none, rules.fit_quality_rules(none, labels)).count() == 0
    assert pieces.encode_pieces(none, "/opt/tokenizers/piece_bpe_32k.model").count() == 0


def test_learning_is_the_same_from_any_layout(spark, docs_of):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["calm", "fine", "words", "here", "nothing", "else"], 12)) + (" grumblewort fizzlehead" if k % 4 == 0 else "") for k in range(400)]
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(400)], "doc_id long, quality int, toxic int")
    docs = docs_of(texts)
    a, b = (toxicity.fit_toxicity(d, labels) for d in (docs, docs.repartition(5)))
    assert np.array_equal(a.triples, b.triples) and np.array_equal(a.curve, b.curve)
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0]
    scored = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, a).collect()}
    assert all(scored[k] == int(k % 4 == 0) for k in held)
