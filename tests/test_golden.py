"""Cases with plain answers: texts, numbers, urls, state, and how operators take nulls, ties, empty tables and repeated rows. Values
are written here, not taken from the code."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hearthline.functions import extract, hashing, text, urls
from hearthline.operators import extraction, jobs, listings, quality, search, select, state, training
from hearthline.sources import files


def one(spark, value, body):
    return spark.createDataFrame([(value,)], "x string").select(body(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "given, want",
    [("São Paulo", "sao paulo"), ("Coração de Jesus", "coracao de jesus"), ("BAIRRO Açaí", "bairro acai"), ("Centro-Sul (Região)", "centrosul regiao"), ("", ""), ("Rua 123 - Apartamento", "rua 123 apartamento")],
)
def test_normalised(spark, given, want):
    assert one(spark, given, text.normalize) == want == text.normalized(given)


@pytest.mark.parametrize(
    "given, want",
    [("casa praia", ["casa", "praia"]), ("apartamento coração", ["apartamento", "coracao"]), ("centro", ["centro"]), ("", []), ("  casa   grande  ", ["casa", "grande"]), ("2-quartos, piscina!", ["2quartos", "piscina"])],
)
def test_terms(spark, given, want):
    assert text.search_terms(given) == want


@pytest.mark.parametrize("given, want, fixed", [("R$ 150000", 150, 150_000), ("R$ 99999,90", 999, 99_999.9), ("R$ 500.000,00", 500_000, 500_000), ("R$ 1.500,50", 1500.5, 1500.5), ("", 0, 0)])
def test_prices(spark, given, want, fixed):
    assert one(spark, given, extract.value) == want and one(spark, given, extract.value_fixed) == fixed


def test_numbers_in_text(spark):
    assert one(spark, "1.200 m²", extract.area) == 1.2
    assert one(spark, "3 QUARTOS", extract.rooms) == 3 and one(spark, "2 banheiros", extract.baths) == 2 and one(spark, "nada", extract.rooms) == 0
    assert one(spark, "CEP 37890-000 e 12345678", extract.cep) == "37890-000"


def test_urls(spark):
    assert one(spark, "https://x.com/a///b/", urls.for_hash) == "https:/x.com/a//b"
    assert one(spark, "https://x.com/a?b=1#c", urls.for_search) == "https://x.com/a" and one(spark, "ftp://x", urls.for_search) == ""


def test_content_hash(spark):
    import hashlib

    row = spark.range(1).select(hashing.content_hash(F.array(F.lit(" R$ 1 "), F.lit("")), F.array(F.lit("Rua A")), F.array().cast("array<string>")).alias("h")).first()
    assert row.h == hashlib.sha256(b"prices:[r$ 1]|addresses:[rua a]|descriptions:[]").hexdigest()


LISTING = "id string, descricao string, cidade string, bairro string, tipo_imovel string, endereco string, valor double, quartos int, banheiros int, area_total double, url string"


def make(spark, *rows):
    full = [tuple({"id": "1", "descricao": "", "cidade": "", "bairro": "", "tipo_imovel": "", "endereco": "", "valor": 0.0, "quartos": 0, "banheiros": 0, "area_total": 0.0, "url": "u", **r}.values()) for r in rows]
    return spark.createDataFrame(full, LISTING)


def test_search(spark):
    rows = make(spark, {"id": "a", "descricao": "Casa Pequena", "valor": 2e5}, {"id": "b", "descricao": "Casa Média com piscina", "valor": 5e5, "cidade": "Rio de Janeiro"}, {"id": "c", "descricao": "Casa Grande", "valor": 1e6, "cidade": "São Paulo"})
    found = lambda **asked: sorted(r.id for r in search.matching(rows, search.SearchFilter(**asked)).collect())
    assert found(cidade="rio de janeiro") == ["b"] and found(q="piscina") == ["b"] and found(valor_min=3e5, valor_max=8e5) == ["b"]
    assert found(cidade="São Paulo") == [] and found(cidade="São Paulo", fixed=True) == ["c"]
    assert found(q="de a o") == found(valor_max=0) == ["a", "b", "c"]
    assert [r.id for r in search.page(rows, search.SearchFilter(), 0, 0).collect()] and search.page(rows, search.SearchFilter(), 2, 10).count() == 0
    assert search.totals(rows.limit(0), search.SearchFilter()).first().total_pages == 0
    with pytest.raises(ValueError):
        search.SearchFilter(valor_min=2, valor_max=1)


def test_bounds_of_listings(spark):
    errors = lambda **r: make(spark, r).select(F.size(quality.errors()).alias("n")).first().n
    assert errors(endereco="Rua A, 1") == 0 and errors(url="", valor=5000.0) == 1 and errors() == 1
    assert [errors(valor=v) for v in (999.0, 1000.0, 1e8, 1e8 + 1)] == [1, 0, 0, 1]
    assert [errors(endereco="x", quartos=q) for q in (50, 51)] == [0, 1] and [errors(endereco="x", banheiros=b) for b in (20, 21)] == [0, 1]
    assert [errors(endereco="x", area_total=a) for a in (0.0, 9.9, 10.0)] == [0, 1, 0]
    assert [errors(endereco="a" + "," * n) for n in (5, 6)] == [0, 1]
    savable = lambda **r: make(spark, r).where(listings.savable()).count()
    assert savable(endereco="a", cidade="b", descricao="c") == 1
    assert savable(cidade="b", descricao="c") == savable(endereco="a", descricao="c") == savable(endereco="a", cidade="b") == 0
    clean = listings.cleaned(make(spark, {"endereco": "  Rua \n A ", "valor": -5.0})).first()
    assert clean.endereco == "Rua A" and clean.valor == 0 and clean.tipo_imovel == "Outro"


def test_state_at_its_bounds(spark):
    at = dt.datetime(2024, 1, 20)
    log = spark.createDataFrame([("a", at, 1, "success", "h"), ("a", at, 2, "failed", "h"), ("b", at - dt.timedelta(days=1), 3, "success", None), (None, at, 4, "success", "h")], "url string, processed_at timestamp, seq long, status string, hash string")
    last = {r.url: r.seq for r in state.latest(log).collect()}
    assert last == {"a": 2, "b": 3, None: 4}
    assert state.retained(log, F.lit(at).cast("timestamp")).count() == 3
    assert state.latest(log.limit(0)).count() == 0 and state.changes(log.limit(0)).count() == 0


def test_jobs(spark):
    cities = spark.createDataFrame([(1, "done"), (1, "failed"), (2, "done"), (3, None), (3, "done")], "job long, state string")
    assert {r.job: (r.progress, r.status) for r in jobs.ended(cities).collect()} == {1: (100, "completed_with_errors"), 2: (100, "completed"), 3: (50, "running")}
    assert jobs.ended(cities.limit(0)).count() == 0
    stats = jobs.validation_statistics(spark.createDataFrame([], "kind string, confidence double")).first()
    assert stats.total_validations == 0 and stats.property_rate is None


def test_reference_lines(spark):
    rows = spark.createDataFrame([("1|https://a",), ("# no",), ("",), ("x|http://b",), ("httpfoo",), (None,), ("  2|https://c ",)], "line string")
    assert [r.url for r in files.reference_urls(rows).collect()] == ["https://a", "http://b", "https://c"]
    assert [r.url for r in files.reference_urls(rows, numbered_only=True).collect()] == ["https://a", "httpfoo", "https://c"]
    with pytest.raises(ValueError):
        files.supplied(rows, files.PAGES)


HTML = """<html><head><title> T </title></head><body class="page">
<div id="top" class="a b"><p>one<p>two <b>bold</b></div><ul class="features"><li>x<li>y &amp; z</ul><img src="1.png"><a href='/q?p=1'>go</a></body></html>"""


@pytest.mark.parametrize(
    "selector, want",
    [("p", ["one", "two bold"]), (".a.b", ["onetwo bold"]), ("#top b", ["bold"]), (".features li", ["x", "y & z"]), ("[class*='eat'] li", ["x", "y & z"]), ("a[href*='p=']", ["go"]), ("b, title", ["T", "bold"]), ("p:contains('two')", ["two bold"]), ("ul p", []), ("img[src]", [""]), ("*:contains('bold')", None)],
)
def test_selectors(selector, want):
    found = [e.text().strip() for e in select.Page(HTML).find(selector)]
    assert found == want if want is not None else len(found) == 5


def test_pages_of_any_kind(spark):
    rows = [(None, None, None, 1), (1, "https://a/1", "", 2), (1, "https://a/1", HTML, 3), (1, "https://a/1", HTML, 3), (2, "https://a/2", "<p>" + "palavra " * 200_000, 4), (3, "https://a/3", "<b>R$ 5", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    out = extraction.extracted(extraction.gathered(pages)).collect()
    assert sorted((r.page_id or 0, r.valor) for r in out) == [(0, 0.0), (1, 0.0), (1, 0.0), (1, 0.0), (2, 0.0), (3, 5.0)]
    assert extraction.enhanced(extraction.gathered_enhanced(pages)).count() == len(rows) and extraction.fingerprints(pages).count() == len(rows)
    empty = pages.limit(0)
    assert extraction.extracted(extraction.gathered(empty)).count() == extraction.catalog_items(empty).count() == training.by_host(empty).count() == 0


def test_folds_keep_order(spark):
    rows = [("h", i, v, 0, 0, 0, 0, 0, i == 2, False, False, False, {"price": s}) for i, (v, s) in enumerate([(10, [".a"]), (5, [".b", ".a"]), (8, [".c"])])]
    names = ", ".join([*[f"{c} long" for c in training.NUMBERS], *[f"{c} boolean" for c in training.FLAGS]])
    examples = spark.createDataFrame(rows, f"host string, seq long, {names}, selectors map<string,array<string>>").repartition(3)
    row = training.folded(examples, "host").first()
    assert (row.n, row.text_length, row.has_gallery) == (3, ((10 + 5) // 2 + 8) // 2, True)
    assert training.selectors_by(examples, "host").first().selectors == {"price": [".a", ".b", ".c"]}


def test_requests_that_are_refused(spark):
    from hearthline import api

    rows = make(spark, {"id": "a", "descricao": "casa", "valor": 5000.0})
    page, totals = api.find(rows, q="casa")
    assert [r.id for r in page.collect()] == ["a"] and totals.first().total == 1
    for bad in (lambda: api.find(rows, q="x" * 201), lambda: api.find(rows, number=1001), lambda: api.find(rows, valor_min=5, valor_max=1), lambda: api.cleanup(rows, rows), lambda: api.delete_city(rows, "a"), lambda: api.city(rows, ""), lambda: api.forget_visits(rows, F.current_timestamp(), 0)):
        with pytest.raises(ValueError):
            bad()
    assert api.cleanup(rows, rows, everything=True)[2].startswith("Banco de dados completamente limpo")


def test_rate_limit_at_its_bounds(spark):
    from hearthline.streaming import rate_limit

    rows = [(1, 0, 1), (1, 0, 2), (1, 10_000_000, 3), (1, 10_000_001, 4), (2, 5, 5), (None, 7, 6), (None, 8, 7), (None, 9, 8)]
    requests = spark.createDataFrame(rows, "client long, at long, seq long").repartition(3)
    got = {r.seq: r.allowed for r in rate_limit.limited(requests, 2, 10).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: True, 6: True, 7: True, 8: False}
    assert rate_limit.limited(requests.limit(0), 2, 10).count() == 0


@pytest.mark.parametrize("hot", [0, 3, 1_000_000])
def test_rate_limit_by_jumps_is_the_rate_limit(spark, hot):
    import random

    from hearthline.streaming import rate_limit

    rng = random.Random(hot)
    clients = [1] * 5 + [2, 3, None, None]
    rows = [(rng.choice(clients), rng.randrange(0, 400) * 500_000, k) for k in range(900)] + [(4, 7, 1000), (5, 0, 1001), (5, 10_000_000, 1002), (5, 10_000_001, 1003), (0, 3, 1004)]
    requests = spark.createDataFrame(rows, "client long, at long, seq long").repartition(5)
    want, start, count = {}, {}, {}
    for client, at, seq in sorted(rows, key=lambda r: r[1:]):
        if client not in start or at - start[client] > 10_000_000:
            start[client], count[client] = at, 0
        want[seq] = (client, at, count[client] < 2)
        count[client] += want[seq][2]
    got = rate_limit.limited(requests, 2, 10, hot=hot).collect()
    assert {r.seq: (r.client, r.at, r.allowed) for r in got} == want and len(got) == len(rows)
    assert rate_limit.by_jumps(requests.limit(0), 2, 10).count() == 0


def test_best_reference_pattern_against_all_pairs(spark):
    import re

    from hearthline.operators import learn

    def base(host):
        parts = re.sub(r"^www\.", "", host).split(".")
        return ".".join(parts[-3:] if parts[-1] == "br" else parts[-2:])

    hosts = ["www.casa.com.br", "casa.com.br", "lar.casa.com.br", "minhacasa.com", "casa.com", "a.com", "outro.org", "com.br", ""]
    paths = ["/imovel/12", "/imovel/7", "/v2/imovel/12", "/imovel-12.html", "/imovelx12", "/imovel/{id}", "/a1", "/a12", "/", "", "/venda/3/4", "/venda/3/5"]
    patterns = ["/imovel/{id}", "/imovel/12", "/v2/imovel/{id}", "/imovel-{id}.html", "/a1{id}", "/a{id}", "/venda/3/{id}", "/venda/{id}/4", "/venda/{id}/{id}", "", "/x"]
    pages = [(k, f"https://{h}{p}?q=1") for k, (h, p) in enumerate((h, p) for h in hosts for p in paths)]
    learned = [(f"{d}|{p}", d, p, (7 * k % 10) / 10) for k, (d, p) in enumerate((d, p) for d in hosts for p in patterns if (len(d) + len(p)) % 3)]
    want = {}
    for k, url in pages:
        host, path = re.match(r"https://([^/?#]*)([^?#]*)", url).groups()
        scores = []
        for name, domain, pattern, sure in learned:
            points = 0.4 if base(host) == base(domain) else 0.2 if base(domain) in host or base(host) in base(domain) else 0.0
            points += 0.3 * bool(re.fullmatch(re.escape(pattern).replace(r"\{id\}", r"[0-9]+"), path))
            scores.append((-round(points + 0.3 * sure, 9), name))
        want[k] = min(scores)
    learned = spark.createDataFrame(learned, "name string, domain string, pattern string, confidence double")
    pages = spark.createDataFrame(pages, "id long, url string")
    out = learn.best_reference(pages, learned)
    assert {r.id: (-r.score, r.name) for r in out.collect()} == want
    assert {(r.name, r.score) for r in learn.best_reference(pages, learned.limit(0)).collect()} == {(None, None)}
    assert learn.best_reference(pages.limit(0), learned).count() == 0
