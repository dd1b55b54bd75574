import duckdb
from scoreloom.llm import reputation
from scoreloom.llm.queries import URLS

PAGES, LABELS = "page_id long, url string, host string, good int", "doc_id long, quality int, id long"


def judged(rows_of, pages, labels, **more):
    df = rows_of([(*p, "x", 0) for p in pages], PAGES)
    return reputation.judged(df, rows_of([(*x, 0) for x in labels], LABELS), **(URLS | more))


def test_rules_and_parts(rows_of):
    cases = {
        "http://A.b.NET/x?q#f": ("a.b.net", "/x", "net/", "block"),
        "https://www.example.net/en/1": ("www.example.net", "/en/1", "example.net/en/", "allow"),
        "https://notexample.net/en/1": ("notexample.net", "/en/1", "net/", "block"),
        "http://net?x": ("net", "", None, "allow"),
        "http://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"),
        "http://example.com/de": ("example.com", "/de", None, "allow"),
        "ftp://x.org/fr/y?z://q": ("x.org", "/fr/y", "org/fr/", "allow"),
        "É.com": ("", "", None, "allow"),
        "http://É.Z.com#/p": ("É.z.com", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    pages = [(k, url) for k, url in enumerate(cases)]
    got = {r["id"]: r for r in judged(rows_of, pages, [(1, 1)]).collect()}
    for k, expected in enumerate(cases.values()):
        assert (got[k]["host"], got[k]["path"], got[k]["rule"], got[k]["verdict"]) == expected


def test_hosts_are_shrunk_towards_their_domain(rows_of):
    pages, labels = [], []
    for host, good, bad in (("a.good.com", 40, 0), ("b.good.com", 0, 1), ("a.bad.com", 0, 40), ("b.bad.com", 1, 0), ("c.bad.com", 0, 0)):
        for k in range(max(1, good + bad)):
            pages.append((len(pages), f"http://{host}/{k}"))
            if good + bad:
                labels.append((len(pages) - 1, int(k < good)))
    got = {r["host"]: r for r in judged(rows_of, pages, labels).collect()}
    assert got["a.good.com"]["verdict"] == "allow"
    assert got["a.bad.com"]["verdict"] == got["c.bad.com"]["verdict"] == "block"
    assert got["b.bad.com"]["reputation"] < got["b.good.com"]["reputation"] + 1
    assert 0 < got["c.bad.com"]["reputation"] < got["b.bad.com"]["reputation"]


def test_suffixes_of_two_labels(rows_of):
    host, suffix = reputation._domains(reputation.F.col("host"), ("co.uk",))
    df = rows_of([("a.b.co.uk",), ("b.co.uk",), ("co.uk",), ("x.y.uk",), ("uk",), ("",)], "host string")
    got = {r[0]: (r[1], r[2]) for r in df.select("host", host, suffix).collect()}
    assert got == {"a.b.co.uk": ("b.co.uk", "co.uk"), "b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.y.uk": ("y.uk", "uk"), "uk": ("uk", "uk"), "": ("", "")}


def test_odd_rows_as_sql(rows_of):
    urls = [None, "", "x", "http://", "http://h.com", "http://H.com/a", "http://h.com/a", "http://b.org:80/fr/?x", "http://" + "a." * 3000 + "net/"]
    pages = [(k % 8, u) for k, u in enumerate(urls)] + [(None, "http://h.com/a")]
    labels = [(0, 1), (0, 0), (0, 1), (4, 0), (5, 1), (6, None), (7, 5), (None, 1), (99, 0)]
    columns = ["id", "host", "path", "rule", "verdict", "labelled"]
    got = judged(rows_of, pages, labels).collect()
    with duckdb.connect() as db:
        db.execute("create table pages (page_id bigint, url varchar)")
        db.execute("create table labels (doc_id bigint, quality integer)")
        db.executemany("insert into pages values (?, ?)", pages)
        db.executemany("insert into labels values (?, ?)", labels)
        expected = db.execute(reputation.statement(**URLS)).fetchall()
    assert sorted((str([r[c] for c in columns]), round(r["bound"], 6)) for r in got) == sorted((str(list(r[:6])), r[7]) for r in expected)


def test_empty_tables(rows_of):
    assert judged(rows_of, [], []).collect() == []
    assert [r["reputation"] for r in judged(rows_of, [(1, "http://a.com/")], []).collect()] == [0.5]
