import itertools
import math
import re

from wordloom.llm import queries, url_filter

SF_DIR = "/root/testdata/sf0.001"


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match("[^?#]*", rest[len(host) :])[0]


def rule(host, path):
    best = None
    for verdict, name in queries.URL_RULES:
        of_host, of_path = name.split("/", 1)
        if (host == of_host or host.endswith("." + of_host)) and path.startswith("/" + of_path) and (best is None or len(name) > len(best[1])):
            best = (verdict, name)
    return best


def test_query_follows_rules_and_signs(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").select("page_id", "url").collect()}
    rows = queries.op10_url_filter(spark, SF_DIR).collect()
    assert len(rows) == len(urls)
    for row in rows:
        assert (row.host, row.path) == split_url(urls[row.page_id])
        told = rule(row.host, row.path)
        assert row.rule == (told[1] if told else None)
        assert row.verdict == (told[0] if told else "block" if row.log_odds > 0 else "allow")
        assert row.host_words.replace(" ", "") == "".join(re.findall("[a-z]+", row.host.rpartition(".")[0]))


def best_split(piece, counts, total):
    def chance(word):
        return math.log(counts[word] / total) if word in counts else math.log(10 / total) - len(word) * math.log(10)

    options = []
    for cuts in itertools.product([0, 1], repeat=len(piece) - 1):
        bounds = [0, *(i + 1 for i, cut in enumerate(cuts) if cut), len(piece)]
        words = [piece[a:b] for a, b in zip(bounds, bounds[1:])]
        options.append(sum(map(chance, words)))
    return max(options)


def test_viterbi_finds_the_most_likely_words():
    counts, total = {"cheap": 5, "pills": 4, "che": 2, "app": 9, "ills": 1, "a": 50, "heap": 3}, 100
    for piece in ("cheappills", "heapa", "xyz", "acheap", "ppp"):
        of_parts = {(i, j): counts[piece[i:j]] for i in range(len(piece)) for j in range(i + 1, len(piece) + 1) if piece[i:j] in counts}
        words = url_filter.viterbi(piece, of_parts, total)
        assert "".join(words) == piece
        got = sum(math.log(counts[w] / total) if w in counts else math.log(10 / total) - len(w) * math.log(10) for w in words)
        assert abs(got - best_split(piece, counts, total)) < 1e-9
    assert url_filter.viterbi("", {}, 1.0) == []


URLS = [
    None, "", "no scheme", "://", "http://", "https://Cheap-Pills.example.NET/buy?x=1", "http://cheappills24.com", "http://dailynews.com/about#top",
    "http://user.x.org/es/", "http://example.org/es/1", "http://example.org/en/12", "http://a.example.org/en/2", "http://com/fr/", "http://xcom/de/",
    "http://www.example.com/de/?a", "http://example.com/DE/", "HTTP://Grüße.EXAMPLE.com/é://x", "ftp://" + "a" * 3000 + ".com/" + "b/" * 5000,
]


def test_edges(spark):
    rows = [(i, url, None if i % 3 else "<p>daily news of pills</p>", "x") for i, url in enumerate(URLS + URLS[5:8])]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string, verdict string")
    got = {row.page_id: row for row in url_filter.judge_urls(frame, queries.URL_RULES).collect()}
    assert len(got) == len(rows)
    joined = {row.page_id: row for row in url_filter.judge_urls(frame, queries.URL_RULES, max_bytes=0).collect()}
    assert joined == got
    for page_id, url, _, _ in rows:
        row = got[page_id]
        assert (row.host, row.path) == split_url(url)
        assert (row.rule, row.verdict) == (lambda r: (r[1], r[0]) if r else (None, "block" if row.log_odds > 0 else "allow"))(rule(row.host, row.path))
    assert got[6].verdict == "block" and got[6].host_words == ["cheap", "pills"] and got[0].verdict == "allow"
    assert got[7].host_words == ["daily", "news"] and got[7].verdict == "allow"
    assert url_filter.judge_urls(frame.limit(0), queries.URL_RULES).count() == 0


def test_model_learns_from_a_table_and_meets_hosts_kept_out(spark):
    """Words that no list in the module has, on hosts that the labelled table lacks."""
    bad_words, good_words = ("zorblat", "quimfex"), ("harbour", "lantern")
    told = [(f"http://{w}-{i}{x}.example.net/a", True) for w in bad_words for i, x in enumerate("kvw")]
    told += [(f"http://{w}-{i}{x}.example.net/a", False) for w in good_words for i, x in enumerate("kvw")]
    seeds = {word for line in (*url_filter.BAD, *url_filter.GOOD) for word in line.split()}
    assert not seeds & {*bad_words, *good_words}
    labelled = spark.createDataFrame(told, "url string, bad boolean")
    html = "<p>zorblat quimfex harbour lantern</p>"
    rows = [(1, "http://zorblat-quimfex.example.net/b", html), (2, "http://lantern.example.net/b", html), (3, "http://zorblatquimfex.com/", html)]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    got = {r.page_id: r for r in url_filter.judge_urls(pages, (), labelled=labelled).collect()}
    assert [got[i].verdict for i in (1, 2, 3)] == ["block", "allow", "block"] and got[3].host_words == ["zorblat", "quimfex"]
    assert {r.verdict for r in url_filter.judge_urls(pages, ()).collect()} == {"allow"}


def test_pages_that_rules_decide_are_learned_without_the_rules_own_words(spark):
    rows = [(i, f"http://zorblat-{x}.example.org/es/qq", "<p>zorblat</p>") for i, x in enumerate("kvwz")]
    rows += [(10, "http://zorblat.example.net/qq", ""), (11, "http://other.example.net/es/", "")]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    got = {r.page_id: r for r in url_filter.judge_urls(pages, [("block", "example.org/es/")]).collect()}
    assert got[10].rule is None and got[10].verdict == "block" and got[11].verdict == "allow"


def test_no_bad_host_of_the_pages_is_in_the_seed_list(spark):
    hosts = {split_url(r.url)[0] for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").select("url").collect()}
    labels = {label.replace("-", " ") for host in hosts for label in host.split(".") if "-" in label}
    assert labels and not labels & set(url_filter.BAD)
