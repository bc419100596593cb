"""Column functions against known values."""

from pyspark.sql import functions as F

from setloom import functions as fn


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(k) for k, c in cols.items())).first()


def test_names(spark):
    names = {"Function [Innate Editions]": "Function", "We Feel [MFF] For You": "We Feel  For You", "Track [Producer Remix]": "Track [Producer Remix]", "A [Extended Mix] [Label]": "A [Extended Mix]", "A [remixed]": "A", "[dub] B [Dubplate]": "[dub] B", "plain": "plain"}
    got = spark.createDataFrame([(k,) for k in names], "n string").select("n", fn.clean_name(F.col("n")).alias("c")).collect()
    assert {r.n: r.c for r in got} == names
    r = one(spark, k=fn.record_key(F.lit("Â Dj-9"), F.lit(" x!")), s=fn.split_title(F.lit("a - b - c")), t=fn.split_title(F.lit("abc")), o=fn.own_music(F.lit("The Nina Kraviz Band"), F.lit("Nina Kraviz")), p=fn.own_music(F.lit("abc"), F.lit("abc")), w=fn.word_overlap(F.lit("one two Two three"), F.lit("two four one")))
    assert r.k == "dj9x" and tuple(r.s) == ("a", "b - c") and tuple(r.t) == ("", "abc") and r.o and not r.p and abs(r.w - 2 / 3) < 1e-12


def test_numbers(spark):
    r = one(
        spark,
        a=fn.camelot_distance(F.lit(1), F.lit(True), F.lit(12), F.lit(False)),
        b=fn.camelot_distance(F.lit(None).cast("int"), F.lit(True), F.lit(3), F.lit(True)),
        c=fn.grid_snap(F.lit(25.0), 10),
        d=fn.affine(F.lit(30.0), F.lit(100.0), F.lit(1.5)),
        e=fn.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))),
        f=fn.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))),
        g=fn.log_ratio(F.lit(2.0), F.lit(1.0), 0.5),
    )
    assert (r.a, r.b, r.c, r.d, r.f, r.g) == (1.5, 2.5, 20.0, 120.0, None, 0.5) and abs(r.e - 0.5**0.5) < 1e-12
