"""Small tables with the awkward cases, and brute-force versions."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(n: int = 60, seed: int = 3) -> list[tuple]:
    """Random texts, exact and near copies, shared passages, nulls, empties and odd characters."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7))) for _ in range(400)] + ["Éte", "naïve", "日本語", "x1", "It's", "😀"]
    passage = [r.choice(words) for _ in range(90)]
    out = []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.choice([3, 40, 80, 300]))]
        if i % 5 == 1:
            k = r.randint(0, len(w))
            a = r.randint(0, 30)
            w[k:k] = passage[a : a + r.randint(30, 60)]
        if i % 7 == 2 and out and out[-1][1]:
            w = out[-1][1].split()
            if i % 2:
                w[r.randrange(len(w))] = "changed"
        t = " ".join(w)
        if i % 4 == 0:
            t = t.replace(" ", "\n", 3).replace(" ", ". ", 5)
        out.append((i * 3, t, "en", f"s{i % 4}", len(t)))
    out += [(1000, None, None, None, None), (1001, "", "en", "s", 0), (1002, " \t\n ", "en", "s", 4), (1003, "one", "en", "s", 3), (1004, "a b\x1cc  d\x0be", None, "s", 8)]
    return out


def pages(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def write(spark, path, data, labels=()):
    pages(spark, data).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{path}/labels.parquet")
    return str(path)
