"""Token counts of whole texts; huge texts are encoded in overlapping chunks that are spliced again."""

from __future__ import annotations

import os
from collections.abc import Iterator
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import tune

_LOADED: dict = {}


class Pieces:
    """A sentencepiece model behind the two methods of a tokenizer that counting needs."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def encode_batch_fast(self, texts: list[str], add_special_tokens: bool = False) -> list:
        return [SimpleNamespace(ids=ids) for ids in self.model.encode(texts, out_type=int)]

    def encode(self, text: str, add_special_tokens: bool = False):
        return SimpleNamespace(ids=self.model.encode(text, out_type=int))


def load_tokenizer(path: str | None):
    """The tokenizer of a .json file or the sentencepiece model of a .model file; None: byte_bpe_50k.json where public_tokenizers has it on this machine."""
    if path not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            _LOADED[path] = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        else:
            _LOADED[path] = Pieces(path) if path.endswith(".model") else Tokenizer.from_file(path)
    return _LOADED[path]


def can_splice(tokenizer) -> bool:
    """Whether texts may be cut at pre-token starts: there is no normaliser, the pre-tokenizer adds no space and never looks behind."""
    from tokenizers.pre_tokenizers import ByteLevel

    if isinstance(tokenizer, Pieces) or tokenizer.normalizer is not None:
        return False
    first = tokenizer.pre_tokenizer
    return isinstance(first, ByteLevel) and first.use_regex and not first.add_prefix_space and all(t.lstrip is t.rstrip is t.single_word is False for t in tokenizer.get_added_tokens_decoder().values())


def _starts(encoding, base: int) -> dict[int, int]:
    """Where pre-tokens start, as characters of the whole text, with the index of their first token."""
    found, last = {}, object()
    for i, (word, (at, _)) in enumerate(zip(encoding.word_ids, encoding.offsets, strict=True)):
        if word != last:
            found[base + at] = i
            last = word
    return found


def encode_spliced(tokenizer, text: str, chunk: int = 65_536, overlap: int = 1_024) -> list[int]:
    """The ids of a text that is encoded chunk by chunk.

    Each chunk runs `overlap` characters into the next. Where both have a pre-token start at one character, the text may
    be spliced: the left chunk has reached it from a true start, and what the right chunk finds from there on depends
    only on what follows, as the pre-tokenizer looks ahead but never behind and merges stay within a pre-token. Starts
    so close to the left chunk's end that the cut, or a special string across it, could have moved them don't count.
    Without a common start, the overlap is doubled, in the end up to the whole rest of the text. A tokenizer for which
    this doesn't hold (can_splice) gets every text whole."""
    n = len(text)
    if n <= chunk + overlap or not can_splice(tokenizer):
        return tokenizer.encode(text, add_special_tokens=False).ids
    margin = 2 + max([8, *(len(t.content) for t in tokenizer.get_added_tokens_decoder().values())])
    overlap = max(overlap, 2 * margin)
    chunk = max(chunk, 2 * overlap)
    ids: list[int] = []
    at, end = 0, min(n, chunk + overlap)  # the left chunk; its start is a true one
    left = tokenizer.encode(text[at:end], add_special_tokens=False)
    skip = 0  # tokens of the left chunk that the ones before have given
    wide = overlap
    while end < n:
        begin = end - wide
        right_end = min(n, begin + chunk + overlap)
        right = tokenizer.encode(text[begin:right_end], add_special_tokens=False)
        a, b = _starts(left, at), _starts(right, begin)
        common = [p for p in a if begin <= p <= end - margin and p in b and a[p] >= skip]
        if common:
            p = min(common)
            ids += left.ids[skip : a[p]]
            left, skip, at, end, wide = right, b[p], begin, right_end, overlap
            continue
        wide = 2 * wide
        end = min(n, end + wide // 2)
        chunk = max(chunk, 2 * wide)
        left = tokenizer.encode(text[at:end], add_special_tokens=False)
        if skip:  # the tokens before the last splice keep their number: what precedes it hasn't changed
            start = next(p for p, i in a.items() if i == skip)
            skip = _starts(left, at)[start]
    return ids + left.ids[skip:]


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, limit: int = 1024, chunk: int = 65_536, overlap: int = 1_024, batch_chars: int = 1 << 19) -> DataFrame:
    """A row for each row of docs: its id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    A null text counts as empty, with 0 bytes and 0 tokens. Repeated rows and null ids stay rows of their own; other
    columns are ignored, whatever their names. Map-only: no shuffle, and the encodings of at most one chunk or one small
    batch are in memory."""
    tune(docs.sparkSession)
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(tokenizer_path)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            n_tokens = [0] * len(texts)
            group: list[int] = []
            size = 0
            for i in range(len(texts) + 1):
                if group and (i == len(texts) or size + len(texts[i]) > batch_chars):
                    for k, e in zip(group, tokenizer.encode_batch_fast([texts[k] for k in group], add_special_tokens=False), strict=True):
                        n_tokens[k] = len(e.ids)
                    group, size = [], 0
                if i < len(texts) and len(texts[i]) > chunk + overlap:
                    n_tokens[i] = len(encode_spliced(tokenizer, texts[i], chunk, overlap))
                elif i < len(texts):
                    group.append(i)
                    size += len(texts[i])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(count, schema)
