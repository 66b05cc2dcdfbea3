from caselens.llm.addresswords import AddressMatcher, align, parse_address, skeleton
from caselens.llm.addresses import link_addresses, shingles
from caselens.llm.linkage import same_cluster_pairs

SCHEMA = "record string, beat_code string, address string, form string, block string, id string"


def test_parse():
    assert parse_address("House No. 163-C, Street 13, Block F, Chandni Bazar, Kotla Sarang 93101") == ("house", "163c", "13", "f", ("chandni", "bazar", "kotla", "sarang"))
    assert parse_address("H#104; Gali # 8; Blk G; Andaz H/S")[:4] == ("house", "104", "8", "g")
    assert parse_address("129, street 12, pathar garh colony")[:4] == ("", "129", "12", "")
    assert parse_address("Gali # 22, Pathar Garh Colony")[1] == ""
    assert parse_address("مکان نمبر 102، گلی نمبر 13، بلاک A، انداز")[:4] == ("house", "102", "13", "a")
    assert parse_address(None)[1] == "" and parse_address("")[1] == ""


def test_alignment():
    assert align(("chandni", "bazar"), ("chandni", "bazar"))[:2] == (0.0, 2)
    cost, matched, left, right = align(("naya", "qasba"), ("qasba",))
    assert matched == 1 and left == 1 and right == 0 and cost == 0.5
    # a longer gap costs less than two gaps
    assert align(("a1", "b1", "c1"), ("c1",))[0] == 0.6
    assert skeleton("چاندنی") == skeleton("chandni")


def test_similarity():
    m = AddressMatcher(frozenset({"kotla", "sarang"}))
    s = lambda a, b: m.similarity(parse_address(a), parse_address(b))
    full = "House No. 94, Street 11, Block E, Zaitoon Mohalla, Kotla Sarang 93147"
    assert s(full, "H No 94, E Block, Mohalla Zaitoon") > 0.5
    assert s(full, "house 94 St 11 Moh. Zatoon") > 0.8
    assert s(full, "House No. 94-B, Street 11, Zaitoon Mohalla") == 0
    assert s(full, "House No. 94, Street 12, Zaitoon Mohalla") == 0
    assert s(full, "Shop No. 94, Street 11, Zaitoon Mohalla") == 0
    assert s(full, "House 94, Kotla Sarang") == 0


def test_links(spark):
    rows = [
        ("a", "B", "House No. 94, Street 11, Zaitoon Mohalla, Kotla Sarang 93147"),
        ("b", "B", "H#94, St 11, Moh. Zaitoon"),
        ("b", "B", "H#94, St 11, Moh. Zaitoon"),
        ("c", "B", "House No. 94, Street 5, Zaitoon Mohalla"),
        ("d", "C", "House No. 94, Street 11, Zaitoon Mohalla, Kotla Sarang 93147"),
        ("e", None, "House No. 94, Street 11, Zaitoon Mohalla"),
        ("f", "B", None),
        ("g", "B", "near the water tank"),
        ("h", "B", "House No. 94, Street 11, " + "Zaitoon " * 3000),
        (None, "B", "House No. 94, Street 11, Zaitoon Mohalla"),
    ]
    df = spark.createDataFrame([(*r, "f", "b", "i") for r in rows], SCHEMA)
    got = {tuple(r) for r in same_cluster_pairs(link_addresses(df, cities=["Kotla Sarang"])).collect()}
    assert ("a", "b") in got and not any("c" in p or "d" in p or "g" in p for p in got)
    assert link_addresses(spark.createDataFrame([], SCHEMA)).count() == 0
    assert shingles(parse_address("House 5"), frozenset()) == ["-"]
