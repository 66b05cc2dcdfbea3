import numpy as np

from caselens.llm.namewords import NameMatcher, parse_name
from caselens.llm.linkage import average_linkage, cluster_links, same_cluster_pairs
from caselens.llm.names import link_names

SCHEMA = "record string, beat_code string, name string, cnic string, form string, block string, cluster string, mark string"


def rows(*r):
    return [(*x, "f", "b", "c", "m") for x in r]


def test_parts():
    assert parse_name("Mr. Khan, Ali") == ("person", ("khan", "ali"))
    assert parse_name("Ali Khan s/o Omar Khan") == ("person", ("ali", "khan"))
    assert parse_name("M/S Foo Motors (Pvt) Ltd")[0] == "org"
    assert parse_name("T.P.S.") == ("org", ("tps",))
    assert parse_name(None) == ("none", ()) and parse_name("  ")[1] == ()


def test_similarity():
    m = NameMatcher(frozenset({"nasir", "iasir"}))
    sim = lambda a, b: m.name(parse_name(a), parse_name(b))
    assert sim("Ali Raza Khan", "Khan Ali Raza") == 1 or sim("Ali Raza Khan", "Khan Ali Raza") > 0.95
    assert sim("A. Raza Khan", "Ali Raza Khan") > 0.65
    assert sim("Sajju Khan", "Sajjad Khan") > 0.65
    assert sim("Tavolia Public School", "T.P.S.") > 0.65
    assert sim("Nasir Khan", "Yasir Khan") == 0
    assert sim("Ali Khan", "Omar Khan") == 0


def brute(n, s, threshold):
    clusters = [[i] for i in range(n)]
    while True:
        best = max(((np.mean([s[x, y] for x in a for y in b]), -i, -j) for i, a in enumerate(clusters) for j, b in enumerate(clusters) if i < j), default=(0, 0, 0))
        if best[0] < threshold:
            return sorted(map(sorted, clusters))
        i, j = -best[1], -best[2]
        clusters[i] += clusters.pop(j)


def random_links(r, n, share):
    s = np.zeros((n, n))
    links = []
    for i in range(n):
        for j in range(i + 1, n):
            if r.random() < share:
                s[i, j] = s[j, i] = r.random()
                links.append((i, j, float(s[i, j])))
    return s, links


def grouped(pairs, n):
    of = dict(pairs)
    out = {}
    for v in range(n):
        out.setdefault(of.get(v, v), []).append(v)
    return sorted(out.values())


def test_average_linkage_against_brute_force():
    r = np.random.default_rng(5)
    for _ in range(40):
        n = int(r.integers(2, 12))
        s, links = random_links(r, n, 0.6)
        assert grouped(average_linkage(links, 0.3), n) == brute(n, s, 0.3)


def test_rounds_give_the_same_clusters(spark):
    r = np.random.default_rng(6)
    s, links = random_links(r, 14, 0.3)
    df = spark.createDataFrame(links, "a long, b long, s double")
    want = brute(14, s, 0.3)
    assert grouped([tuple(x) for x in cluster_links(df, 0.3).collect()], 14) == want
    assert grouped([tuple(x) for x in cluster_links(df, 0.3, held=5).collect()], 14) == want
    assert cluster_links(df.limit(0), 0.3).count() == 0


def test_names_of_many_parts():
    m = NameMatcher()
    a = "Ali Raza Hussain Shah Bukhari Qadri Zaidi Kazmi Rizvi"
    assert m.name(parse_name(a), parse_name(a.replace("Raza", "Rza"))) > 0.9
    assert m.name(parse_name(a), parse_name(a.replace("Raza", "Omar"))) == 0
    many = " ".join(f"ab{chr(97 + k % 26)}{chr(97 + k // 26)}x" for k in range(300))
    assert m.name(parse_name(many), parse_name(many + "y")) > 0


def test_a_large_cluster_gives_all_pairs(spark):
    df = spark.range(300).selectExpr("cast(id as string) record", "id % 2 c")
    got = same_cluster_pairs(df, cluster="c", at_once=40)
    assert got.count() == 2 * 150 * 149 // 2 and got.distinct().count() == got.count()


def test_links(spark):
    df = spark.createDataFrame(
        rows(
            ("r1", "B1", "Jameela Sultana Ghandokar", None),
            ("r2", "B1", "Ghandokar, Jameela Sultana", None),
            ("r3", "B1", "Jameela Sultna Ghandokar", None),
            ("r3", "B1", "Jameela Sultna Ghandokar", None),
            ("r4", "B2", "Jameela Sultana Ghandokar", None),
            ("r5", None, "Jameela Sultana Ghandokar", None),
            ("r6", "B1", None, None),
            ("r7", "B1", "   ", None),
            ("r8", "B1", "Zubair Latif Awrani", "12345-1234567-1"),
            ("r9", "B1", "Z. Awraani", "1234512345671"),
            ("r10", "B1", "Zubair Latif Awrani x" * 400, None),
            (None, "B1", "Zubair Latif Awrani", None),
        ),
        SCHEMA,
    )
    pairs = {tuple(r) for r in same_cluster_pairs(link_names(df)).collect()}
    assert pairs == {("r1", "r2"), ("r1", "r3"), ("r2", "r3"), ("r8", "r9")}


def test_empty(spark):
    assert link_names(spark.createDataFrame([], SCHEMA)).count() == 0
