"""Small tables with everything that may go wrong in them."""

import random

VOCABULARY = [a + b for a in ("ka", "lo", "mi", "ne", "pu", "ra", "so", "ti") for b in ("", "ba", "de", "fi", "go", "hu", "ven", "zor")]


def prose(r, n):
    return " ".join(r.choice(VOCABULARY) + r.choice(VOCABULARY) for _ in range(n))


def edited(r, text, rate):
    out = []
    for w in text.split():
        u = r.random()
        if u < rate / 2:
            out.append(r.choice(VOCABULARY) + "x")
        elif u < rate * 0.75:
            continue
        elif u < rate:
            out += [w, r.choice(VOCABULARY) + "y"]
        else:
            out.append(w)
    return " ".join(out)


def documents(seed=5):
    r = random.Random(seed)
    rows, base, passage = [], prose(r, 300), prose(r, 60)
    add = lambda text, lang="en", source="src0": rows.append((len(rows), text, lang, source))
    for i in range(40):
        add(prose(r, r.randrange(30, 200)), r.choice(["en", "de", "fr", "es", None, "xx"]), r.choice(["src0", "src1", "src2", None]))
    for i in range(60):
        add(edited(r, base, r.choice([0, 0.003, 0.01, 0.02, 0.05, 0.1])))
    for i in range(20):
        add(prose(r, 50) + " " + passage + "\n" + prose(r, 30))
    for i in range(6):
        add(rows[3][1])
    for text in (None, "", " \n\t", "x", "Ein Wort", "\x00\x0b\x1c", "it's 'll <|endoftext|> ÀÉ ß 漢字 🙂"):
        add(text)
        add(text)
    add(prose(r, 20_000))
    add(("word " * 5_000).strip())
    add("q" * 9_000 + " " + "é" * 9_000)
    for text in ("license of " + prose(r, 40), "mail a@b.c " + prose(r, 40), "a | b | c | " + prose(r, 40)):
        add(text)
    for i in range(12):  # junk that labels mark
        add(" ".join(w.upper() + "!!" for w in prose(r, 80).split()))
    return rows


CLASHES = ("row", "node", "score", "probability", "shard", "bucket", "version", "copy", "topic", "n_tokens", "digest", "class_id", "size", "virtual_slot", "runs", "id", "packed", "cell_lang", "n")


def write(spark, path, empty=False):
    from pyspark.sql import functions as F

    rows = [] if empty else documents()
    extra = [] if empty else [rows[0], rows[5], (None, "no id here", "en", "src1"), (None, None, None, None)]
    d = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    d = d.withColumns({c: F.lit(c) for c in CLASHES})
    d.repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [] if empty else [(i, int(i < 140), 0) for i in range(0, 160)] + [(None, 1, 0), (3, None, None), (4, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("score", F.lit(1)).write.parquet(f"{path}/labels.parquet")
    r = random.Random(9)
    first = rows[0][1] if rows else ""
    items = [] if empty else [(1, " ".join(first.split()[3:17])), (2, " ".join(first.split()[10:14]).upper()), (3, None), (4, ""), (5, "Ein wort"), (5, "ein WORT"), (None, prose(r, 12)), (10, prose(r, 30))]
    spark.createDataFrame(items, "item_id long, text string").withColumn("spans", F.lit(1)).write.parquet(f"{path}/benchmark.parquet")
    page = lambda i, url, html: (i, url, html)
    big = "<html>" + prose(r, 300) + "</html>"
    pages = [] if empty else [page(1, "https://www.Example.ORG/en/1?x=1#t", big), page(2, None, None), page(3, "no scheme", ""), page(4, "http://a.com/de/x.html", big), page(4, "http://a.com/de/x.html", big), page(None, "http://b.com:80", "short"), page(6, "http://example.org/es/", "short"), page(7, "http://b.fr.com/fr/7?utm=1", big + "é")]
    pages += [] if empty else [page(100 + i, f"http://{'bad' if i % 3 == 0 else 'good'}.net/p/{i}", f"p{i}") for i in range(60)]
    spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: F.lit(c) for c in ("key", "host", "has", "rule", "keeper", "digest")}).write.parquet(f"{path}/pages.parquet")
    v = lambda *x: list(x)
    vectors = [] if empty else [(i, v(r.gauss(0, 1), r.gauss(0, 1), r.gauss(0, 1)), 0) for i in range(150)] + [(i, v(0.5, 0.5, 0.25), 1) for i in range(150, 190)]
    vectors += [] if empty else [(200, None, 0), (201, v(1.0, None, 0.0), 0), (202, v(float("nan"), 0.0, 0.0), 0), (203, v(float("inf"), 0.0, 0.0), 0), (220, v(), 0), (240, v(1.0, 2.0), 0), (241, v(1.0, -2.0), 0), (None, v(1.0, 1.0, 1.0), 0), (40, v(0.1, 0.2, 0.3), 0), (260, v(1e9, -1e9, 1e8), 0)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").withColumns({"x": F.lit(1), "rank": F.lit(1)}).write.parquet(f"{path}/embeddings.parquet")
    return str(path)
