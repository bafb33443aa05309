"""Language identification by compression with per-language raw-content zstandard dictionaries.

Each language's dictionary is a run of pieces of its training texts. A text is reduced to its lower-cased letters and cut into blocks, every block is
compressed once with each dictionary, and the language with the smallest sum wins. The relative distance to the runner-up
is the margin; texts with a margin under `margin` are rejected.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchlake.llm.common import ddl, sliced

UND = "und"
BLOCK = 512
LEVEL = 6
_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")


def _letters(text: str) -> bytes:
    """Lower-cased, with any run of other characters than letters as one space."""
    return _OTHER.sub(" ", text.lower()).encode("utf-8", "replace")


def held_out(fold: int, of: int) -> Column:
    """Whether crc32 of doc_id as text leaves `fold` modulo `of`; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of == fold, F.lit(False))


def train(docs: DataFrame, per_language: int = 512, piece: int = 192, most_languages: int = 1000) -> dict[str, bytes]:
    """Dictionary content of each non-null lang of docs: per_language pieces of `piece` characters.

    About per_language documents of a language (the smallest hashes of doc_id and text) are sampled and cut into pieces from end to end; of
    these the ones of the smallest hashes are taken, wherever they stand. More than most_languages languages are an error.
    """
    rows = docs.filter("lang is not null and text is not null and length(text) > 0").withColumn("h", F.xxhash64("doc_id", F.length("text")) / F.lit(2.0**64) + 0.5)
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(most_languages + 1).collect()}
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    if not sizes:
        return {}
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, 1.5 * per_language / n)))])
    parts = rows.filter(F.col("h") < share[F.col("lang")]).select("lang", "h", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))).alias("k", "part"))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("h", "k"), "part")
    held = parts.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= per_language).select("lang", "r", "part").collect()
    out: dict[str, list[bytes]] = {}
    for r in sorted(held, key=lambda r: (r["lang"], r["r"])):
        out.setdefault(r["lang"], []).append(_letters(r["part"]))
    return {lang: b" ".join(parts) for lang, parts in out.items()}


def classify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = 0.01, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of carry, lang_pred, score, rejected for each row of docs (doc_id, text); repeated rows and null doc_ids come out as they went in.

    A null text, or one without a letter, is `und` with score 0 and rejected; so is everything if there is no
    dictionary. score is the margin over the runner-up (1 if there is one language only); ties go to the
    first language in alphabetical order and are rejected.
    """
    names = sorted(dictionaries)

    def run(batches):
        import zstandard

        packers = []
        for name in names:
            d = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            packers.append(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress)
        for pdf in sliced(batches):
            out = []
            for text in pdf["text"]:
                if not names or not text or not _LETTER.search(text):
                    out.append((UND, 0.0, True))
                    continue
                raw = _letters(text)
                blocks = [raw[lo : lo + BLOCK] for lo in range(0, len(raw), BLOCK)]
                sizes = [sum([len(pack(b)) for b in blocks]) for pack in packers]
                best = min(range(len(names)), key=sizes.__getitem__)
                second = min((s for k, s in enumerate(sizes) if k != best), default=None)
                gap = 1.0 if second is None else (second - sizes[best]) / second
                out.append((names[best], gap, gap < margin))
            yield pdf[list(carry)].assign(**{"lang_pred": [o[0] for o in out], "score": [o[1] for o in out], "rejected": [o[2] for o in out]})

    return docs.select(*dict.fromkeys((*carry, "text"))).mapInPandas(run, ddl(docs, list(carry)) + ", lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, fold: int = 2, of: int = 4, margin: float = 0.01) -> DataFrame:
    """Learns from the documents outside the held-out fold and classifies all: doc_id, held_out, lang_pred, score, rejected."""
    dictionaries = train(docs.filter(~held_out(fold, of)))
    return classify(docs, dictionaries, margin).withColumn("held_out", held_out(fold, of)).select("doc_id", "held_out", "lang_pred", "score", "rejected")
