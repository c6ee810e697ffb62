import random
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomarc.llm import budget as B
from loomarc.llm import encode as E
from loomarc.llm import mixture as M
from loomarc.llm import tokens as K
from loomarc.llm import unigram as U

pytestmark = pytest.mark.skipif(not Path(K.TOKENIZERS, "byte_bpe_50k.tiktoken").exists(), reason="no vocabularies here")


@pytest.fixture(scope="module")
def ranks():
    return K.load_ranks(f"{K.TOKENIZERS}/byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=K.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(5)
    odd = ["a", "Z", "é", "汉", "字", " ", "\n", "9", "²", "_", ".", "​", "👩", "'s", " the", "ing", "\x1c", "\x85", "Ⅷ", "۳"]
    out = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 50))) for _ in range(300)]
    out += ["".join(chr(rng.choice([rng.randint(32, 0x2FFF), rng.randint(0x3000, 0xD7FF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(30)) for _ in range(150)]
    return [*out, "a" * 5000, "<|endoftext|>", "", None]


def test_ids_and_counts(spark, ranks, reference):
    rows = [(i, t, 1) for i, t in enumerate(texts())]
    want = {i: reference.encode_ordinary(t) if t else [] for i, t, _ in rows}
    got = {r["doc_id"]: r["ids"] for r in E.token_ids(spark.createDataFrame(rows, "doc_id bigint, text string, ids int"), "doc_id", "text").collect()}
    assert got == want
    assert all(E.decode(got[i], ranks) == t for i, t, _ in rows if t)
    assert K.counter()([t for _, t, _ in rows]) == [len(want[i]) for i, _, _ in rows]
    assert E.token_ids(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text").count() == 0


def test_long_words(ranks, reference, monkeypatch):
    """Unbroken sequences: same ids in stretches of any size, in time and memory that grow with the length."""
    rng = random.Random(9)
    alphabets = ["acgt", "ab", "a", "the of", "0123456789abcdef", "-=", "汉字表", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]
    cases = ["".join(rng.choice(a) for _ in range(n)).replace(" ", "") for a in alphabets for n in (1100,)]
    cases += ["b" + "a" * 1501, "aab" * 500]
    own = E.Encoder(ranks)
    for text in cases:
        want = reference.encode_ordinary(text)
        for rows in (E.ROWS, 600):
            monkeypatch.setattr(E, "ROWS", rows)
            own.words.clear(), own.fragments.clear()
            got = own.encode([text])[1]
            assert np.frombuffer(got, np.int32).tolist() == want
    monkeypatch.undo()
    text = "".join(rng.choice("acgt") for _ in range(100_000))
    begin = time.process_time()
    assert len(own.encode([text])[1]) // 4 == len(reference.encode_ordinary(text))
    assert time.process_time() - begin < 40


def test_other_vocabularies():
    for name in ("byte_bpe_multi_50k", "word_bpe_49k", "piece_bpe_32k"):
        counts = K.counter(name)(["hello world, grüße", "", None])
        assert counts[0] > 0 and counts[1:] == [0, 0]
    with pytest.raises(FileNotFoundError):
        K.counter("no_such_vocabulary")


def test_unigram_counts():
    from tokenizers import Tokenizer, models

    rng = random.Random(2)
    pieces = [("<unk>", 0.0)] + [(c, -5 - rng.random()) for c in "abcdef汉é"]
    pieces += list({"".join(rng.choice("abcdef汉é") for _ in range(rng.randint(2, 5))): -rng.random() * 8 - 1 for _ in range(300)}.items())
    library, own = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=False)), U.Unigram(pieces)
    for _ in range(500):
        text = "".join(rng.choice("abcdef汉éxyz") for _ in range(rng.randint(1, 40)))
        assert own.count(text) == len(library.encode(text).ids)
    import json

    for text in ("abc" * 40, "x" * 500, "abc" * 40):  # long segments are counted and not remembered
        assert own.counts([text, text]) == [len(library.encode(text).ids)] * 2
    assert sum(map(len, own._known)) == own._held == 0
    assert U.from_tokenizer_json(json.loads(library.to_str())).counts(["abc", "", None])[1:] == [0, 0]


DOCS = "doc_id bigint, text string, source string, lang string, task string, loaded_at timestamp, tokens int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, s, lang, task, None, 7) for i, t, s, lang, task in rows], DOCS).drop("tokens")


def test_budget(spark, reference):
    docs = documents(spark, [(1, "hello world", "a", "EN", "t"), (1, "hello world", "a", "EN", "t"), (2, None, None, "zh-CN", None), (3, "汉字", "b ", None, ""), (4, "", "a", "xx", "T")])
    meta = spark.createDataFrame([(1, "german", "u", 3, "2026-01-02", "c"), (1, "fr", "v", 11, "2026-01-01", "d"), (9, "en", "t", 1, "2026-01-01", "e"), (4, "", None, None, None, "f")],
        "doc_id bigint, language string, task string, context_chars bigint, recorded_at string, case_id string")
    got = {r.doc_id: r for r in B.labelled_tokens(docs, meta).collect()}
    assert (got[1].language, got[1].task, got[1].tokens, got[1].stale) == ("de", "u", 2, True)
    assert (got[2].source, got[2].language, got[2].tokens) == ("unknown", "zh", 0) and got[3].source == "b" and (got[4].language, got[4].task) == ("unknown", "t")
    totals = {(r.source, r.language, r.task): r for r in B.totals(B.labelled_tokens(docs, meta)).collect()}
    assert totals["*", "*", "*"].documents == 4 and totals["*", "*", "*"].tokens == 2 + len(reference.encode_ordinary("汉字"))
    assert B.totals(B.labelled_tokens(docs.limit(0), meta.limit(0))).where("documents > 0").count() == 0


def brute_mixture(sized, weights, repeats, total):
    out = set()
    for source, weight in weights.items():
        rows = sorted(((place >> 40) % M.BUCKETS, place, i, n) for i, s, n, place in sized if s == source)
        whole, at = sum(r[3] for r in rows), 0
        for _, _, i, n in rows:
            at += n
            out |= {(i, k) for k in range(repeats[source]) if (k * whole + at) / weight <= total}
    return out


def test_mixture(spark):
    rng = random.Random(4)
    rows = [(i, "word " * rng.randint(1, 30), "big" if i % 3 else "small", None, None) for i in range(300)] + [(900, None, "big", None, None), (901, "x", None, None, None), (902, "y", "unlisted", None, None)]
    docs = documents(spark, rows)
    targets = spark.createDataFrame([("big", 0.3, 1), ("small", 0.5, 3), ("missing", 0.2, 2)], "source string, target_share double, max_repeats bigint")
    sized = M.sized_documents(docs)
    mixed = M.mixture(docs, targets, sized=sized)
    got = [(r.doc_id, r.repeat_no, r.finish) for r in mixed.collect()]
    held = [(r.doc_id, r.source, r.tokens, r.place) for r in sized.collect()]
    plan = {r.source: r for r in M.capacities(sized, targets).collect()}
    assert plan["missing"].weight == 0 and abs(plan["small"].weight - 0.625) < 1e-12
    total = plan["big"].largest_total
    assert {(i, k) for i, k, _ in got} == brute_mixture(held, {"big": 0.375, "small": 0.625}, {"big": 1, "small": 3}, total)
    assert [f for *_, f in got] == sorted(f for *_, f in got) and len(got) == len({(i, k) for i, k, _ in got})
    shares = {r.source: r for r in M.shares(sized, targets, mixed).collect()}
    assert abs(shares["small"].actual_share - 0.625) < 0.02 and shares["missing"].uses == 0 and shares["small"].passes <= 3
    for source, weight in (("big", 0.375), ("small", 0.625)):  # no source is further from its share than one document
        longest = max(n for _, s, n, _ in held if s == source)
        assert 0 <= weight * total - shares[source].tokens <= longest
    assert M.mixture(docs, targets, total=0, sized=sized).count() == 0
    empty = M.sized_documents(docs.limit(0))
    assert M.mixture(docs, targets, sized=empty).count() == 0 and M.shares(empty, targets, M.mixture(docs, targets, sized=empty)).count() == 3
