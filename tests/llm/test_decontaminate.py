"""Literal and re-parameterised leaks; clean documents stay."""

import random

from weftline.llm import decontaminate as D

ITEM = "In the market Anna buys 12 apples and 7 pears for 30 dollars while Peter sells Anna 12 more apples every day"
OTHER = "Weaving a plain cloth needs warp and weft threads that cross each other over and under in turn"
FILL = "some unrelated words about the weather stand here without any meaning at all"


def run(spark, docs, bench=((1, ITEM), (2, OTHER))):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(list(bench), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in D.contaminated(d, b).collect()}


def test_leaks_are_found(spark):
    changed = ITEM.replace("Anna", "Maria").replace("12", "45").replace("7", "9").replace("30", "80").replace("Peter", "Jonas")
    broken = ITEM.replace("Anna buys 12", "Maria buys 45").replace("sells Anna 12", "sells Karla 99").replace("7", "9")
    half = " ".join(OTHER.split()[:12])
    junk = " | ".join(f"{w}%%%" for w in OTHER.split())
    docs = [(10, f"{FILL} {ITEM} {FILL}"), (11, changed), (12, broken), (13, FILL), (14, OTHER.upper()), (15, half), (16, junk), (17, f"{changed}. {FILL} {ITEM}"), (18, None), (19, ""), (None, OTHER), (20, OTHER), (20, OTHER)]
    got = run(spark, docs)
    assert set(got) == {(10, 1), (11, 1), (17, 1), (14, 2), (15, 2), (16, 2), (None, 2), (20, 2)}
    assert got[11, 1]["consistent"] == 1 and got[20, 2]["n_matched"] == len(OTHER.split()) - D.WIDTH + 1


def test_short_and_empty_items(spark):
    docs = [(1, "before alpha beta gamma delta epsilon after"), (2, "one two three"), (3, "1 2 3 4 5 6 7 8 9 10")]
    bench = [(5, "Alpha beta gamma delta epsilon"), (6, "one two three"), (7, None), (8, ""), (9, "11 12 13 14 15 16 17 18 19 20"), (None, "before alpha beta gamma delta epsilon after")]
    assert set(run(spark, docs, bench)) == {(1, 5), (2, 6)}
    assert run(spark, docs, []) == {} == run(spark, [], bench)


def test_templates(spark):
    text = "Yesterday, Mr. Smith ran 3.5 km with Al Bo Cy and 20 kg of DNA, KM later"
    row = spark.createDataFrame([(text,)], "text string").select(D.tokens(D.F.col("text")).alias("raw")).withColumn("form", D.template(D.F.col("raw"))).first()
    assert row["form"] == ["yesterday", "<name>", "smith", "ran", "<num>", "<unit>", "with", "<name>", "<name>", "<name>", "and", "<num>", "<unit>", "of", "dna", "km", "later"]


def test_both_join_ways_agree(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    bench = [(i, " ".join(rng.choices(words, k=rng.randint(4, 20)))) for i in range(15)]
    docs = [(i, " ".join(rng.choices(words, k=20)) + (" " + rng.choice(bench)[1] if i % 3 == 0 else "")) for i in range(60)]
    one = run(spark, docs, bench)
    monkeypatch.setattr("weftline.llm._shared.BROADCAST_KEYS", -1)
    assert run(spark, docs, bench) == one and one


def test_clean_keeps_the_rest(spark):
    docs = spark.createDataFrame([(1, OTHER, "a"), (2, FILL, "b"), (None, OTHER, "c"), (3, None, "d")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(2, OTHER)], "item_id long, text string")
    out = D.clean(docs, bench)
    assert out.columns == docs.columns and sorted(r["item_id"] for r in out.collect()) == ["b", "c", "d"]


def test_generated_documents(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = {r["doc_id"] for r in D.contaminated(docs, bench).collect()}
    items = [" ".join(r["text"].split()) for r in bench.collect()]
    literal = {r["doc_id"] for r in docs.select("doc_id", "text").collect() if any(x in " ".join(r["text"].split()) for x in items if len(x.split()) > 8)}
    assert literal <= found


def test_literal_copies_of_short_and_slot_heavy_items(spark):
    sums = "Compute 12 + 7 + 9 + 30 + 45 + 81 and 6 x 8"
    people = "List: Anna, Peter, Maria, Jonas, Karla, Simon, Erika, Bruno"
    bench = [(1, "What is 2 + 2?"), (2, "Define entropy briefly."), (3, sums), (4, people), (5, "Why?"), (6, "Hello there")]
    docs = [(10, f"{FILL} What is 2 + 2? {FILL}"), (11, f"{FILL} What is 3 + 3? {FILL}"), (12, "Please define Entropy briefly, {FILL}"), (13, f"{FILL} {sums} {FILL}"), (14, f"{FILL} compute 1 + 2 + 3 + 4 + 5 + 6 and 7 x 9"), (15, f"They say {people}."), (16, "They say List: Bob, Tim, Mia, Joe, Kim, Sam, Eva, Ben."), (17, "why"), (18, f"why {FILL}"), (19, "Hello, there!"), (20, f"hello there {FILL}")]
    assert set(run(spark, docs, bench)) == {(10, 1), (12, 2), (13, 3), (15, 4), (17, 5), (19, 6)}


def test_sql_gives_the_same_rows(spark, tmp_path):
    import duckdb
    from weftline.llm.queries import ORACLE_SQL

    bench = [(1, "What is 2 + 2?"), (2, "Define entropy briefly."), (3, ITEM), (4, "Compute 12 + 7 + 9 + 30 + 45 + 81 and 6 x 8"), (5, "Why?"), (6, None), (7, "")]
    docs = [(10, f"{FILL} What is 2 + 2? {FILL} {ITEM}"), (11, ITEM.replace("12", "13").replace("Anna", "Maria")), (12, f"define entropy briefly {FILL}"), (13, f"{FILL} Compute 12 + 7 + 9 + 30 + 45 + 81 and 6 x 8 {FILL}"), (14, "why?"), (15, None)]
    con = duckdb.connect()
    for name, rows, kinds in (("documents", docs, "doc_id BIGINT, text VARCHAR"), ("benchmark", bench, "item_id BIGINT, text VARCHAR")):
        con.execute(f"CREATE TABLE {name} ({kinds})")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    cur = con.execute(ORACLE_SQL["op7_decontamination"])
    names = [d[0] for d in cur.description]
    want = {(r["doc_id"], r["item_id"]): r for r in (dict(zip(names, x, strict=True)) for x in cur.fetchall())}
    got = {k: r.asDict() for k, r in run(spark, docs, bench).items()}
    assert got == want and set(got) == {(10, 1), (10, 3), (11, 3), (12, 2), (13, 4), (14, 5)}
