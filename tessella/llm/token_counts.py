"""Token counts by the whole-token shortcut.

A byte-level BPE splits a text into pre-tokens and merges each on its own, so a
text's count is the sum over its pre-tokens.  ``prove_single`` finds, once on the
driver and with the library itself, which vocabulary strings are one pre-token
that encodes to exactly their own id; those count 1 by a set lookup.  Only the
rest is merged, by the library, once per distinct pre-token and worker.

Where this module's split could differ from the library's (characters of newer
Unicode versions, and texts that spell a special token) the library encodes the
whole text.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._common import table

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
#: Distinct merged pre-tokens that a worker remembers.
MEMO = 200_000

#: Up to U+024F these classes equal \p{L}, \p{N} and \s, and the standard library's engine is faster.
_L = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_N = "0-9²³¹¼-¾"
_S = "\t-\r \u0085 "
LATIN = rf" ?[{_L}]+|'(?:[stmd]|re|ve|ll)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
ANY = r" ?\p{L}+|'(?:[stmd]|re|ve|ll)| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose class depends on the Unicode version of a library.
UNSURE = (
    "՘֋-֌࢏౜೜₏₝-₟꟎-꟏꟒꟔꟝꟢꟱꭬-꭭"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    "\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016ed3\U00016ff2-\U00016ff6"
    "\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    "\U0001df1f-\U0001dfff\U0001e6c0-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U0003fc3f"
)


def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def supported(path: str) -> None:
    """Raise unless the file describes the plain byte-level BPE that the shortcut is proved for."""
    with open(path) as f:
        spec = json.load(f)
    pre, model = spec["pre_tokenizer"] or {}, spec["model"]
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and model["type"] == "BPE"
    if not plain or spec["normalizer"] or spec["truncation"] or model.get("dropout"):
        raise ValueError(f"{path} isn't a plain byte-level BPE")


def prove_single(path: str) -> tuple[list[str], list[str]]:
    """The vocabulary strings that encode alone to exactly their own token, and the special strings."""
    tok = _load(path)
    special = {t.content for t in tok.get_added_tokens_decoder().values()}
    chars = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    byte_of = {chr(b): b for b in chars} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in chars)}
    plain, ids = [], []
    for shown, i in tok.get_vocab(with_added_tokens=False).items():
        try:
            plain.append(bytes(byte_of[c] for c in shown).decode())
            ids.append(i)
        except (KeyError, UnicodeDecodeError):
            continue  # part of a character: never a whole pre-token
    single = [s for s, i, e in zip(plain, ids, tok.encode_batch(plain, add_special_tokens=False)) if e.ids == [i] and s not in special and len(tok.pre_tokenizer.pre_tokenize_str(s)) == 1]
    return sorted(single), sorted(special)


class Counter:
    """Counts the tokens of texts; one lives in each task."""

    def __init__(self, path: str, single: list[str], special: list[str], memo: int = MEMO):
        import regex

        self.tok = _load(path)
        self.single, self.memo, self.cost = single, memo, dict.fromkeys(single, 1)
        self.latin, self.any = re.compile(LATIN).findall, regex.compile(ANY).findall
        self.beyond = re.compile("[^\0-ɏ]").search
        self.whole = re.compile("|".join([f"[{UNSURE}]", *map(re.escape, special)])).search

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if self.whole(text):
            return len(self.tok.encode(text, add_special_tokens=False).ids)
        pieces = (self.any if self.beyond(text) else self.latin)(text)
        try:
            return sum(map(self.cost.__getitem__, pieces))
        except KeyError:
            pass
        cost = self.cost
        new = [p for p in dict.fromkeys(pieces) if p not in cost]
        if len(cost) + len(new) > len(self.single) + self.memo:
            cost = self.cost = dict.fromkeys(self.single, 1)
            new = [p for p in dict.fromkeys(pieces) if p not in cost]
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            cost.update(zip(part, (len(e.ids) for e in self.tok.encode_batch(part, add_special_tokens=False))))
        return sum(map(cost.__getitem__, pieces))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of each row of ``docs``.

    A null or empty text has 0 bytes and 0 tokens; repeated rows and null keys are
    kept as they are; other columns are ignored.  ``tokenizer`` is a file name in
    ``public_tokenizers`` that exists on every machine.
    """
    import public_tokenizers

    supported(public_tokenizers.path(tokenizer))
    single, special = prove_single(public_tokenizers.path(tokenizer))
    known = docs.sparkSession.sparkContext.broadcast((single, special))  # the vocabulary: a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        count = Counter(public_tokenizers.path(tokenizer), *known.value)
        for b in batches:
            n = [count(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["k", "n_bytes", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.octet_length(F.col(text)).cast("long"), F.lit(0).cast("long")).alias("n_bytes"), F.col(text).alias("t"))
    out = rows.mapInArrow(run, f"k {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("k").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), TOKENIZER)


QUERIES = {"op9_token_counts": op9_token_counts}
ORACLES: dict[str, str] = {}
