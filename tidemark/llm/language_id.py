"""Language identification by compression.

Each learned language has a zstandard raw-content dictionary made of a bounded sample
of labelled texts: a piece of each, from a place in it that a hash of the text chooses.
A text is compressed whole with every dictionary; the smallest output names its
language. Where the two smallest are close the prediction is marked rejected.

Defined cases: null text or text without a letter: `und`, score 0, rejected. No
labelled text at all: `und` for every row. Ties go to the first language by name. A
text of any length is compressed whole, within one task. Repeated rows each get a
result; extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bound of the sample: texts of each language, and characters of the piece taken of each.
SAMPLE_TEXTS, PIECE_CHARS = 160, 800
MAX_LANGUAGES = 500
LEVEL = 9
MARGIN = 0.02


def learn_dictionaries(labelled: DataFrame, texts: int = SAMPLE_TEXTS, chars: int = PIECE_CHARS) -> dict[str, bytes]:
    """Raw dictionary content of each language of `labelled` (doc_id, text, lang)."""
    begin = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - chars, F.lit(0)) + 1).cast("int") + 1
    rows = labelled.where("lang is not null and text is not null").select("lang", "doc_id", F.substr("text", begin, F.lit(chars)).alias("piece"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "piece")
    sample = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= texts)
    content = sample.groupBy("lang").agg(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("n", "piece"))), lambda x: x["piece"])).alias("content"))
    got = {r[0]: r[1].encode() for r in content.limit(MAX_LANGUAGES + 1).collect()}
    if len(got) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return dict(sorted(got.items()))


def _predict(content: dict[str, bytes], margin: float):
    def run(batches):
        made = []
        for lang, data in content.items():
            d = zstd.ZstdCompressionDict(data, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            made.append((lang, zstd.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)))
        for b in batches:
            lang, score, rejected = [], [], []
            for value in b.column("text"):
                text = value.as_py()
                if not made or text is None or not any(map(str.isalpha, text)):
                    lang.append("und"), score.append(0.0), rejected.append(True)
                    continue
                raw = text.encode()
                sizes = sorted((len(c.compress(raw)), k) for k, (_, c) in enumerate(made))
                gap = 1 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0
                lang.append(made[sizes[0][1]][0]), score.append(gap), rejected.append(gap < margin)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return run


def held_out(doc_id: str = "doc_id"):
    """Whether a document's label is kept out of learning: crc32 of its id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict_languages(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row. score: by how much smaller the best output is than the next, 0 to 1."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out"))
    return rows.mapInArrow(_predict(dictionaries, margin), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
