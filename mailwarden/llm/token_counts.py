"""Token counts: batches of texts balanced by bytes go through a public tokenizer inside Arrow functions; only
lengths come back."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, fresh

# White space as the tokenizers' patterns have it: Python's, without four control characters.
SPACE, OTHER = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]"
#: Pieces between safe cuts. A cut is safe where white space follows another character: no token of a byte-level BPE
#: with the usual pre-tokenizer spans such a place, and special strings hold no white space.
PIECES = re.compile(rf"{SPACE}*{OTHER}+|{SPACE}+")
#: Within long pieces, between an ASCII letter and a digit: pre-tokenizers never join them, and special strings have no digits.
INNER_CUT = re.compile(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
LONG_PIECE = 4096


def pieces(text: str) -> list[str]:
    """A text cut at safe places."""
    found = PIECES.findall(text)
    if len(text) > LONG_PIECE and max(map(len, found)) > LONG_PIECE:
        found = [y for x in found for y in (INNER_CUT.split(x) if len(x) > LONG_PIECE else (x,))]
    return found


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(docs: DataFrame, text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", batch_bytes: int = 1 << 18, kept_pieces: int = 300_000, out_col: str = "n_tokens") -> DataFrame:
    """docs with a column of token counts, as the library gives them for whole texts.

    No begin or end tokens are added; special strings inside texts are treated as the library does by default. Null
    texts count as empty: 0 tokens. `out_col` gets underscores before it where docs has such a column.

    Texts are cut at all safe places, so their counts add up. The library gets the pieces whose counts a task doesn't
    know yet, in batches balanced by bytes, whatever the number and length of rows; a task keeps the counts of about
    kept_pieces pieces, then begins anew. Long stretches without white space are cut between letters and digits;
    what has neither, as a long Chinese text, is one piece to the tokenizer too. Repeated rows get equal counts; an
    empty table gives no rows. Texts for .model vocabularies,
    which treat white space in another way, are encoded whole.
    """
    bounded_batches(docs.sparkSession)
    (out_col,) = fresh(docs, out_col)
    (text,) = fresh(docs, "text_to_count")
    names = [*docs.columns, out_col]
    schema = T.StructType([*docs.schema.fields, T.StructField(out_col, T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary_path(vocabulary)
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            encode = getattr(tok, "encode_batch_fast", tok.encode_batch)
            lengths = lambda xs: [len(e) for e in encode(xs, add_special_tokens=False)]
            cut = pieces
        else:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            lengths = lambda xs: [len(e) for e in sp.encode(xs, num_threads=1)]
            cut = lambda t: [t]
        known: dict[str, int] = {}

        def learn(new: set[str]) -> None:
            part: list[str] = []
            size = 0
            for x in new:
                part.append(x)
                size += len(x.encode())
                if size >= batch_bytes:
                    known.update(zip(part, lengths(part), strict=True))
                    part, size = [], 0
            if part:
                known.update(zip(part, lengths(part), strict=True))

        for batch in batches:
            totals: list[int] = []
            waiting: list[list[str]] = []
            size = 0

            def settle() -> None:
                learn({p for ps in waiting for p in ps if p not in known})
                totals.extend(sum(map(known.__getitem__, ps)) for ps in waiting)
                waiting.clear()
                if len(known) > kept_pieces:
                    known.clear()

            sizes = pc.binary_length(batch.column(text)).fill_null(0).to_pylist()
            for value, n_bytes in zip(batch.column(text), sizes, strict=True):
                waiting.append(cut(value.as_py() or ""))
                size += n_bytes
                if size >= batch_bytes:
                    settle()
                    size = 0
            settle()
            kept = [batch.column(i) for i, c in enumerate(batch.schema.names) if c != text]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(totals, pa.int64())], names=names)

    return docs.withColumn(text, F.col(text_col)).mapInArrow(count, schema)
