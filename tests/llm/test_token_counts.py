import random

import pytest

from tessera.llm.packing import _fast_encoder, encode
from tessera.llm.token_counts import can_splice, count_tokens, encode_spliced, load_tokenizer


def scramble(seed):
    r = random.Random(seed)
    parts = ["word " * r.randint(1, 60), " " * r.randint(1, 60), "<|endoftext|>", "x" * r.randint(1, 500), "漢字かな" * r.randint(1, 40), "don't we'll 're", "\n\n \t", "😀" * r.randint(1, 9), "123 456"]
    return "".join(r.choice(parts) for _ in range(r.randint(1, 40)))


@pytest.mark.parametrize("seed", range(40))
def test_spliced_equals_whole(seed):
    t, text = load_tokenizer(None), scramble(seed)
    assert encode_spliced(t, text, 64 << seed % 3, 32) == t.encode(text, add_special_tokens=False).ids


def test_no_common_boundary_widens_to_the_end():
    t = load_tokenizer(None)
    for text in ("a" * 5000, " " * 3000, "a" * 3000 + " " + "b" * 3000, ""):
        assert encode_spliced(t, text, 64, 32) == t.encode(text, add_special_tokens=False).ids


def test_counts(spark):
    t = load_tokenizer(None)
    texts = [None, "", "plain words", scramble(1) * 3, "é" * 2000, "dup", "dup"]
    docs = spark.createDataFrame([(i if i else None, x, "clash") for i, x in enumerate(texts)], "doc_id long, text string, n_tokens string")
    got = sorted((r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in count_tokens(docs, chunk=300, overlap=40).collect())
    want = [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]
    assert got == sorted((len((x or "").encode()), n, n > 1024) for x, n in zip(texts, want, strict=True))
    assert count_tokens(docs.limit(0)).collect() == []


def test_fast_library_agrees_over_latin_1():
    """The faster library is used for texts of these characters alone; every one is met in every neighbourhood of classes."""
    if _fast_encoder(None) is None:
        pytest.skip("no second library")
    t, r = load_tokenizer(None), random.Random(5)
    chars = [chr(c) for c in range(256)]
    texts = [a + b + c for a in "a1 '\n.\xa0" for b in chars for c in "s1 \t-\xe9"] + ["".join(r.choice(chars) for _ in range(300)) for _ in range(100)] + [scramble(i) for i in range(10)]
    assert encode(texts, None) == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_same_pattern_and_every_string_of_four_classes():
    """What proves the faster library right: one pattern, and the same split for every neighbourhood of its classes."""
    if _fast_encoder(None) is None:
        pytest.skip("no second library")
    import itertools

    import public_tokenizers
    import regex

    t = load_tokenizer(None)
    assert can_splice(t)
    known = {m for part in public_tokenizers.PATTERN.split("|") for m in regex.findall(r"^'(\w+)$", part)}
    assert known == {"s", "t", "re", "ve", "m", "ll", "d"}
    classes = [" ", "\n", "'", *"strevmld", "x", "7", "-", "\xa0", "\xe9", "\xbd", "A"]
    texts = ["".join(x) for n in range(1, 5) for x in itertools.product(classes, repeat=n)]
    fast = _fast_encoder(None).encode_ordinary_batch(texts)
    for lo in range(0, len(texts), 10_000):
        assert fast[lo : lo + 10_000] == [e.ids for e in t.encode_batch_fast(texts[lo : lo + 10_000], add_special_tokens=False)]


def test_other_tokenizers_get_whole_texts(spark):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    texts = ["Some plain words, " * 50, "Ünïcode   text", "", "\u3000x" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "`doc id` long, text string")
    for name in ("word_bpe_49k.json", "piece_bpe_32k.model"):
        path = public_tokenizers.path(name)
        if name.endswith(".json"):
            t = Tokenizer.from_file(path)
            want = [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
        else:
            want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts, out_type=int)]
        got = {r["doc id"]: r["n_tokens"] for r in count_tokens(docs, id_col="doc id", tokenizer_path=path, chunk=128, overlap=64).collect()}
        assert [got[i] for i in range(len(texts))] == want
