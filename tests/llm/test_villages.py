from pyspark.sql import functions as F

from parcelwright.llm.cadastre import resolve_villages


def test_every_name_within_two_edits_meets(spark):
    villages = spark.createDataFrame([(1, "KARIMUTHOTTAM", None), (2, "MUTHUSANIPETTAI", None)], "lgd_village_code long, village string, local_name string")
    want = {"KARIMUTOTAM": [1], "MUTUSANIPETAI": [2], "KARXMUTHOXTAM": [1], "KARIMUTHOTTAMXY": [1], "XKARIMUTHOTTAMY": [1], "KAIRMUTHOTTAM": [1], "KAXXMUTHOXTAM": None}
    names = spark.createDataFrame([(n,) for n in want], "name string")
    got = {r.name: r.codes for r in names.join(resolve_villages(names, villages), "name", "left").collect()}
    assert got == want
