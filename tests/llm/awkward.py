"""Rows that operators may meet and must give a defined result for."""

import random

from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType


#: Names that the operators use themselves, to show that a table may have them.
CLASHING = ["id", "text_key", "fingerprint", "component_id", "shard", "score", "n_words", "bucket", "u", "v", "spans", "copy", "h1", "key", "lost", "suspected", "n_lines", "part", "mask", "digest", "n", "links", "times", "groups"]
SCHEMA = StructType(
    [StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType())]
    + [StructField(c, DoubleType() if k % 2 else IntegerType()) for k, c in enumerate(CLASHING)]
)


def prose(rng, n, words=("the", "of", "lorem", "ipsum", "dolor", "sit", "amet", "tempor", "été", "straße", "niño", "x1", "42")):
    out = " ".join(rng.choice(words) + rng.choice(["", "", "", ".", ",", "!!"]) for _ in range(n))
    return out.replace(". ", ".\n", 3)


def awkward_rows():
    """Nulls in every column, empty, blank, odd and very long texts, copies, near copies, repeated rows and ids."""
    rng = random.Random(5)
    base = prose(rng, 120)
    line = "This line of some twenty words repeats in several of the documents and has to be taken out of all but one."
    texts = [
        None, "", " ", "\n\n", "\t \r\n", "?!", "1234", "a", "The", "the cat", "the cat sat", base, base, base + " tail", base.upper(), "É È",
        "x" * 60_000, prose(rng, 20_000), "so  many    spaces 　 here", "mixed\x00zero\x1cseparators\x85next", "<|endoftext|> and <|startoftext|>x<|endoftext|>",
        line, "Before.\n" + line + "\nAfter.", line.lower() + "\n" + line, "emoji 😀😀 text 😀", "é combining", "İstanbul ΣΑΣ ß", prose(rng, 3), "don't I'll we've THEY'RE",
    ]
    rows = [(k, t, ["en", "de", None][k % 3], None if k % 4 == 0 else "src", None) for k, t in enumerate(texts)]
    rows += [(None, base, None, None, None), (None, None, None, None, None), (None, line, "en", "s", 1)]
    rows += [(3_000_000_000, prose(rng, 60), "en", "s", 1), (-5, prose(rng, 60), "de", "s", 1), (11, base, "en", "src", None), (27, "another text under an id that is there", "en", "s", 3)]
    return [(*r, *[None] * len(CLASHING)) for r in rows]
