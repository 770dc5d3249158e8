"""Language identification by compression with one raw dictionary per language."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

from callstream.llm.common import ROW, documents, in_arrow, unpacked, whole_row

#: Bytes of sample text per language, and of all dictionaries together (broadcast).
DICTIONARY_BYTES = 128 * 1024
ALL_DICTIONARY_BYTES = 32 * 1024 * 1024
#: Labelled documents per language that set the margin.
MARGIN_DOCUMENTS = 400
#: Bytes of the dictionary that are encoded before each text: a short text by itself would be
#: stored as it is, with the same size for all languages.
LEAD_BYTES = 256
#: Bytes of text that are encoded at a time, afresh: a longer text would be encoded by what it
#: repeats of itself, and the dictionary would leave the window.
PIECE_BYTES = 8 * 1024
#: A lead below this is always too narrow; ties have none.
LEAST_MARGIN = 0.002
ADDED = ("lang_pred", "score", "rejected")


def _parameters() -> zstandard.ZstdCompressionParameters:
    return zstandard.ZstdCompressionParameters.from_level(
        6,
        strategy=zstandard.STRATEGY_LAZY2,
        min_match=3,
        window_log=18,
        hash_log=16,
        chain_log=16,
        write_content_size=0,
        write_checksum=0,
        write_dict_id=0,
    )


class Languages:
    """Raw-content dictionaries by language and the margin below which a text is rejected.

    The languages stand in the order in which ties are broken.
    """

    def __init__(self, samples: dict[str, bytes], margin: float = 0.0):
        self.samples = samples
        self.margin = margin
        self._ready: list[tuple[zstandard.ZstdCompressor, bytes, int]] = []

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_ready": []}

    def sizes(self, text: str) -> list[int]:
        """Bytes that the text, in lower case, adds to the encoding of each language's lead.

        Each piece of PIECE_BYTES is encoded by itself and the sizes are added up.
        """
        if not self._ready:
            parameters = _parameters()
            for sample in self.samples.values():
                content = zstandard.ZstdCompressionDict(
                    sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT
                )
                content.precompute_compress(compression_params=parameters)
                encoder = zstandard.ZstdCompressor(
                    dict_data=content, compression_params=parameters
                )
                lead = sample[:LEAD_BYTES]
                self._ready.append((encoder, lead, len(encoder.compress(lead))))
        data = folded(text)
        pieces = [data[at : at + PIECE_BYTES] for at in range(0, len(data), PIECE_BYTES)]
        return [
            sum(len(encoder.compress(lead + piece)) - own for piece in pieces)
            for encoder, lead, own in self._ready
        ]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, lead of the smallest size over the next (0 to 1), whether it is too narrow."""
        if text is None or not self.samples or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        others = sizes[:best] + sizes[best + 1 :]
        score = 1 - max(sizes[best], 0) / max(min(others), 1) if others else 1.0
        score = min(max(score, 0.0), 1.0)
        return list(self.samples)[best], score, score < self.margin


def folded(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def held_out_fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learn_languages(
    labelled: DataFrame,
    dictionary_bytes: int = DICTIONARY_BYTES,
    margin_documents: int = MARGIN_DOCUMENTS,
    lost: float = 0.003,
    seed: int = 5,
) -> Languages:
    """Dictionaries and margin from a bounded random sample of the labelled documents.

    All rows are counted; of each language, documents enter the sample by the hash of their id
    until about ``dictionary_bytes`` and ``margin_documents`` are met. The dictionary takes a
    stretch of each sampled text, so that long ones do not fill it, and of a small sample at
    least half the texts. The margin is the largest that rejects at most the share ``lost`` of
    the sampled documents, not in a dictionary, whose language is predicted rightly. Ties go to
    the language with more documents.
    """
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL AND text != ''")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Languages({})
    share = min(dictionary_bytes, ALL_DICTIONARY_BYTES // len(counts))
    stretch = 2048
    wanted = math.ceil(3 * share / stretch) + margin_documents
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rates = F.create_map(
        *[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, 1.2 * wanted / n))]
    )
    picked = rows.select("lang", "text", draw.alias("draw")).where(
        F.col("draw") < F.element_at(rates, F.col("lang"))
    )
    order = sorted(counts, key=lambda lang: (-counts[lang], lang))
    sample: dict[str, list[tuple[float, str]]] = {lang: [] for lang in order}
    for row in picked.toLocalIterator():
        sample[row["lang"]].append((row["draw"], row["text"]))
    contents, rest = {}, {}
    for lang, found in sample.items():
        found.sort()
        parts: list[bytes] = []
        used = size = 0
        limit = max(1, len(found) // 2, len(found) - margin_documents // 2)
        for draw_at, text in found[:limit]:
            if size >= share:
                break
            data = folded(text)
            start = int(draw_at * (1 << 30)) % max(1, len(data) - stretch)
            parts.append(data[start : start + stretch])
            size += len(parts[-1])
            used += 1
        contents[lang] = b"\n".join(parts)[:share]
        rest[lang] = [text for _, text in found[used:]]
    model = Languages({lang: c for lang, c in contents.items() if c})
    right = sorted(
        score
        for lang, texts in rest.items()
        for found, score, _ in map(model.predict, texts[:margin_documents])
        if found == lang
    )
    if right:
        model.margin = max(LEAST_MARGIN, right[math.floor(lost * len(right))])
    return model


def _predicted(shared, at: int) -> Callable:
    """Whole rows, whose text is the field ``at``, with what is predicted for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = pc.struct_field(batch.column(0), [at])
            found = [model.predict(text.as_py()) for text in texts]
            langs, scores, narrow = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(langs, pa.string()),
                    pa.array(np.array(scores, float)),
                    pa.array(narrow, pa.bool_()),
                ],
                names=[batch.schema.names[0], *(f"__{name}" for name in ADDED)],
            )

    return run


def identify_languages(docs: DataFrame, model: Languages) -> DataFrame:
    """The documents with ``lang_pred``, ``score`` and ``rejected``.

    The whole text is compressed, piece by piece, with each language's dictionary; the smallest
    sum of sizes names the language, and the text is rejected if its lead is narrower than the model's margin.
    A null text or one without a letter is ``und``, score 0, rejected; so are all texts if no
    language was learned. Equal texts get equal results; an empty table gives an empty table.
    Input columns with the added names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(whole_row(docs))
    at = [name.lower() for name in docs.columns].index("text")
    schema = StructType([rows.schema[ROW]])
    for name, kind in zip(ADDED, (StringType(), DoubleType(), BooleanType())):
        schema = schema.add(f"__{name}", kind)
    found = in_arrow(rows, _predicted(shared, at), schema)
    return found.select(
        *unpacked(docs.columns, ADDED), *[F.col(f"__{name}").alias(name) for name in ADDED]
    )


def op6_language(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("held_out", held_out_fold(F.col("doc_id")))
    model = learn_languages(docs.where("NOT held_out"))
    found = identify_languages(docs.select("doc_id", "held_out", "text"), model)
    return found.select("doc_id", "held_out", *ADDED)
