"""SentencePiece (BPE) encoding and decoding with a prefix table of last tokens.

White space becomes "▁" and one is put in front. No piece holds "▁" after another character, or letters beside other
characters (checked when the model is read), so a text falls into parts like "▁word" that are encoded apart. In a part,
each prefix has exactly one encoding,
and so one last token: an automaton names the pieces that end at a place, and the one whose piece before it, looked up
in the table, forms a pair that merging would leave as it is, is the last token there. The ids are read off backwards.
Characters that no piece covers become byte tokens.

Texts are encoded whole; a part of any length takes time in proportion to it. Null and empty texts have no ids and
decode to the empty text. Rows that repeat encode alike; other columns are kept as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType, StringType, StructField, StructType

from pagelib.llm.common import query, table

SPACE = "▁"
CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
LETTERS = "A-Za-z\u00c0-\u024f\u0370-\u03ff\u0400-\u04ff"      # Latin, Greek, Cyrillic
PART = re.compile(f"{SPACE}*[{LETTERS}]+|{SPACE}*[^{LETTERS}{SPACE}]+|{SPACE}+")
LETTER = re.compile(f"[{LETTERS}]")
CACHE_CHUNKS = 500_000


class Chunks(dict):
    """Ids of each chunk, kept once encoded."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        ids = self[chunk] = self.codec.encode_parts(chunk if chunk[0] == SPACE else SPACE + chunk)
        return ids


class Codec:
    """Encodes and decodes as the sentencepiece library does for one BPE model without normalisation rules."""

    def __init__(self, model_file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.processor = sentencepiece.SentencePieceProcessor(model_file=model_file)
        model = proto.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if (model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces
                or not spec.add_dummy_prefix or not spec.escape_whitespaces):
            raise ValueError("this codec reads BPE models with a dummy prefix and no normalisation")
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte: dict[int, int] = {}
        for i, p in enumerate(model.pieces):
            if p.type == 1:
                if SPACE in p.piece.lstrip(SPACE):
                    raise ValueError(f"piece {i} holds a space mark inside")
                kinds = [LETTER.match(c) is not None for c in p.piece.lstrip(SPACE)]
                if any(a != b for a, b in zip(kinds, kinds[1:])):
                    raise ValueError(f"piece {i} holds letters beside other characters")
                self.score[p.piece], self.id[p.piece] = p.score, i
            elif p.type == 6:
                self.byte[int(p.piece[1:-1], 16)] = i
            elif p.type in (4, 5):
                raise ValueError("user-defined and unused pieces are not read")
        self.pieces = ahocorasick.Automaton()
        for piece in self.score:
            if self.merged(piece) == (piece,):      # a piece that merging never reaches is no token
                self.pieces.add_word(piece, piece)
        self.pieces.make_automaton()
        self.stays = lru_cache(maxsize=1 << 20)(lambda a, b: self.merged(a + b) == (a, b))
        self.cache = Chunks(self)                       # by chunk, or by word where one space mark stands before it
        self.parts: dict[str, tuple[int, ...]] = {}     # by part of a chunk

    def merged(self, text: str) -> tuple[str, ...]:
        """The merging rule itself, for two pieces or one: join the best pair, the first of equals, until none is left."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return tuple(parts)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def last_tokens(self, part: str) -> list[str]:
        """For each prefix of the part, the last piece of its encoding; a character without a piece stands for itself."""
        table: list[str] = []
        stays = self.stays
        for end, piece in self.pieces.iter(part):
            n = len(table)
            if n > end:
                continue                       # this prefix has its piece
            while n < end:                     # no piece ends here
                table.append(part[n])
                n += 1
            start = end - len(piece)
            if start < 0 or stays(table[start], piece):
                table.append(piece)
        table.extend(part[len(table):])
        return table

    def encode_part(self, part: str) -> tuple[int, ...]:
        table = self.last_tokens(part)
        ids: list[int] = []
        end = len(part)
        while end:
            piece = table[end - 1]
            known = self.id.get(piece)
            if known is not None:
                ids.append(known)
            else:
                ids += [self.byte[b] for b in reversed(piece.encode())]
            end -= len(piece)
        return tuple(reversed(ids))

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        cache = self.cache
        if SPACE in text or "  " in text or text[0] == " " or text[-1] == " ":
            chunks = CHUNK.findall(SPACE + text.replace(" ", SPACE))
        else:
            chunks = text.split(" ")     # plain words, each with one space mark before it
        if len(cache) > CACHE_CHUNKS:
            cache.clear()
        return list(chain.from_iterable(map(cache.__getitem__, chunks)))

    def encode_parts(self, chunk: str) -> tuple[int, ...]:
        """A chunk part by part: letters, and what stands between them; no piece reaches over such a border."""
        ids: list[int] = []
        for part in PART.findall(chunk):
            known = self.parts.get(part)
            if known is None:
                if len(self.parts) > CACHE_CHUNKS:
                    self.parts.clear()
                known = self.parts[part] = self.encode_part(part)
            ids += known
        return tuple(ids)

    def decode(self, ids: list[int]) -> str:
        return self.processor.decode(ids)

    def forget(self) -> None:
        """Drop what a task has cached; the worker may do other work next."""
        self.cache.clear()
        self.parts.clear()


@lru_cache(maxsize=4)
def codec(model_file: str) -> Codec:
    """One codec per worker and model."""
    return Codec(model_file)


CODES = StructType([StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()),
                    StructField("decoded_sha256", StringType()), StructField("decoded", StringType())])


def coder(model_file: str, keep_text: bool):
    @pandas_udf(CODES)
    def code(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(model_file)
        for texts in batches:
            counts, ids_hash, text_hash, decoded = [], [], [], []
            for text in texts:
                ids = c.encode(text)
                back = c.decode(ids) if ids else ""
                counts.append(len(ids))
                ids_hash.append(hashlib.sha256(str(ids)[1:-1].replace(" ", "").encode()).hexdigest())
                text_hash.append(hashlib.sha256(back.encode()).hexdigest())
                decoded.append(back if keep_text else None)
            yield pd.DataFrame({"n_tokens": counts, "ids_sha256": pd.Series(ids_hash, dtype=object),
                                "decoded_sha256": pd.Series(text_hash, dtype=object),
                                "decoded": pd.Series(decoded, dtype=object)})
        c.forget()

    return code


def encoder(model_file: str):
    """A column function: text -> array of ids."""

    @pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(model_file)
        for texts in batches:
            yield texts.map(c.encode)
        c.forget()

    return encode


def with_codes(docs: DataFrame, model_file: str, keep_text: bool = False) -> DataFrame:
    """`docs` with n_tokens, ids_sha256, decoded_sha256, and the decoded text if asked for; these names are replaced."""
    own = ["n_tokens", "ids_sha256", "decoded_sha256"] + (["decoded"] if keep_text else [])
    coded = docs.withColumn("__codes", coder(model_file, keep_text)(F.col("text")))
    return coded.withColumns({c: F.col(f"__codes.{c}") for c in own}).drop("__codes")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op6_sentencepiece")
def op6_sentencepiece(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return with_codes(docs, default_model()).drop("text")
