"""Small documents and plain-Python versions of the text operators."""

import random
import re
import zlib

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
SEP = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return SEP.findall(text or "")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def frame(spark, rows, parts=3, **extra):
    """rows: (doc_id, text[, lang, source]); extra columns hold a constant."""
    full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "s")), len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOCS).repartition(parts) if full else spark.createDataFrame([], DOCS)
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(v).alias(k) for k, v in extra.items()])


def held(doc_id, by):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % by


def corpus(n, seed=1, vocabulary=400, copies=True):
    """Documents with exact copies, near copies, shared passages, odd spaces, empty and null texts."""
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(vocabulary)] + ["Été", "ñu", "über", "A", "a"]
    passage = [r.choice(vocab) for _ in range(60)]
    out = []
    for i in range(n):
        kind = r.random()
        if out and kind < 0.15 and copies:
            text = r.choice(out)[1]
        elif out and kind < 0.45:
            base = words(r.choice(out)[1])
            for _ in range(r.randint(1, 3)):
                if base:
                    base[r.randrange(len(base))] = r.choice(vocab)
            text = " ".join(base)
        elif kind < 0.6:
            base = [r.choice(vocab) for _ in range(r.randint(0, 80))]
            at = r.randint(0, len(base))
            text = "\n".join(base[:at] + passage[r.randint(0, 15) :] + base[at:])
        elif kind < 0.64:
            text = r.choice([None, "", " \t\n", "one", "one two", "one two three", "One  two\x0bthree"])
        else:
            text = " ".join(r.choice(vocab) for _ in range(r.randint(1, 120)))
        out.append((i, text))
    return out
