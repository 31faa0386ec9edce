import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tessella.llm import urlfilter as U


def plain_parts(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")


def plain_rule(host, path):
    fits = [(h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda r: len(r[0])) if fits else (None, None)


def plain_split(name, chance):
    """The likeliest split, over all last words of each beginning."""
    best = {0: (0.0, [])}
    for end in range(1, len(name) + 1):
        best[end] = max(((best[a][0] + chance(name[a:end]), best[a][1] + [name[a:end]]) for a in range(max(0, end - 20), end)), key=lambda x: x[0])
    return best[len(name)][1]


def plain_tokens(host, path, chance):
    out = []
    for mark, text in (("h:", host[: max(host.rfind("."), 0)]), ("p:", path.lower())):
        for part in re.findall("[a-z]+|[0-9]+", text):
            out += [mark + "0"] if part.isdigit() else [mark + w for w in plain_split(part, chance)]
    return out


def plain_verdicts(pages):
    counts = Counter(w for _, _, html in pages for w in re.findall("[a-z]+", re.sub("<[^>]*>", " ", html or "").translate({i: i + 32 for i in range(65, 91)})) if len(w) <= 20)
    total = sum(counts.values())
    known = {w: n for w, n in counts.items() if n >= max(2, 1e-6 * total)}
    for s in U.SEEDS:
        known[s] = max(known.get(s, 0), 1e-5 * total)
    whole = total * (1 + 1e-5 * len(U.SEEDS))
    chance = lambda w: math.log(known[w] / whole) if w in known else -math.log(whole) - len(w) * math.log(10)
    rows = [(i, *plain_parts(u)) for i, u, _ in pages]
    tokens = [plain_tokens(h, p, chance) for _, h, p in rows]
    by_host = defaultdict(list)
    for (_, h, _), x in zip(rows, tokens, strict=True):
        by_host[h].append(any(t[2:] in U.SEEDS for t in x))
    texts = defaultdict(list)
    for (_, _, html), (_, h, _) in zip(pages, rows, strict=True):
        words = re.findall("[a-z]+", re.sub("<[^>]*>", " ", html or "").lower())
        texts[h].append((sum(w in U.SEEDS for w in words), len(words)))
    seeds, words = (sum(x[i] for v in texts.values() for x in v) for i in (0, 1))

    def said(h):
        own = texts[h]
        return sum(s > 0 for s, _ in own) >= 0.5 * len(own) and sum(s for s, _ in own) * max(words, 1) >= 2 * sum(n for _, n in own) * max(seeds, 1)

    bad = [sum(by_host[h]) >= 0.1 * len(by_host[h]) or said(h) for _, h, _ in rows]
    seen = {True: Counter(), False: Counter()}
    for x, y in zip(tokens, bad, strict=True):
        seen[y].update(x)
    size = len(seen[True] | seen[False])
    chances = {y: {t: math.log((seen[y][t] + 1) / (seen[y].total() + size)) for t in seen[True] | seen[False]} for y in seen}
    prior = math.log((sum(bad) + 1) / (len(bad) - sum(bad) + 1))
    out = {}
    for (i, h, p), x in zip(rows, tokens, strict=True):
        rule, verdict = plain_rule(h, p)
        score = prior + sum(chances[True][t] - chances[False][t] for t in x)
        out[i] = (h, p, rule, verdict or ("block" if score > 0 else "allow"))
    return out


def test_unseeded_pages_of_bad_hosts_are_blocked(spark):
    """Held-out accuracy: hosts of one trade share words; half of them never show a seed, and are judged by the words alone."""
    r = random.Random(4)
    trade, plain_ = ["lucky", "bonus", "palace", "spins", "vegas", "royal"], ["garden", "school", "recipes", "travel", "museum", "music"]
    rows, truth = [], {}
    for h in range(120):
        bad = h % 3 == 0
        words = r.sample(trade if bad else plain_, 3)
        host, shows = f"{words[0]}{words[1]}{h}.org", h % 2
        for i in range(10):
            seed = "casino" if bad and shows and i < 3 else "info"
            rows.append((len(rows), f"http://{host}/{seed}/{words[2]}/{i}", f"<p>{' '.join(trade + plain_)} info casino page</p>"))
            truth[len(rows) - 1] = bad, bad and not shows
    got = {x.page_id: x.verdict == "block" for x in U.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    hidden = [got[i] for i, (_, h) in truth.items() if h]
    assert sum(got[i] == b for i, (b, h) in truth.items() if not h) >= 0.95 * sum(not h for _, h in truth.values())
    assert sum(hidden) >= 0.95 * len(hidden)


def test_texts_decide_where_urls_say_nothing(spark):
    """No URL holds a seed. Three of four bad hosts are told by their texts; the fourth has none and is judged, as held out, by the words that its name and paths share with them. Good hosts that mention a seed stay."""
    r = random.Random(7)
    trade, plain_ = ["lucky", "bonus", "palace", "spins", "vegas", "royal"], ["garden", "school", "recipes", "travel", "museum", "music"]
    filler = " ".join(trade + plain_)
    rows, truth, hidden = [], {}, set()
    for h in range(120):
        bad, silent = h % 4 == 0, h % 16 == 0
        words = r.sample(trade if bad else plain_, 3)
        host = f"{words[0]}{words[1]}{h}.org"
        for i in range(10):
            seed = "casino jackpot" if bad and not silent and i < 7 else "casino" if h % 10 == 3 and i == 0 else "town"
            rows.append((len(rows), f"http://{host}/{words[2]}/{i}", None if silent else f"<a href='/spam'>{filler}</a> {seed} page {filler}"))
            truth[len(rows) - 1] = bad
            hidden |= {len(rows) - 1} if silent else set()
    assert not any(s in u for s in U.SEEDS for _, u, _ in rows)
    got = {x.page_id: x.verdict == "block" for x in U.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert sum(got[i] == b for i, b in truth.items()) >= 0.97 * len(truth)
    assert sum(got[i] for i in hidden) >= 0.9 * len(hidden) > 0


def test_query_matches_a_plain_version(spark, data):
    pages = [tuple(r) for r in spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url", "html").collect()]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.op4_url_filter(spark, data).collect()}
    assert got == plain_verdicts(pages)


def test_rare_tokens_count_in_full(spark, monkeypatch):
    """Seeds and tokens below the share for the broadcast give the score that they give above it."""
    rows = [(i, f"x://shop{i % 7}.org/news/{'abcdefg'[i % 7] * 3}") for i in range(60)] + [(100, "x://warez.org/get"), (101, "x://crack.org/get"), (101, "x://crack.org/get"), (102, None)]
    pages = spark.createDataFrame([(i, u, "<p>warez crack shop news get</p>") for i, u in rows], "page_id long, url string, html string")
    tokens = spark.createDataFrame([(["h:warez", "p:get"], True), (["h:crack", "p:get"], False), *[(["h:shop"], False)] * 60], "tokens array<string>, listed boolean")
    scores = lambda: sorted((r.page_id, round(r.score, 9), r.verdict) for r in U.filter_urls(pages).collect())
    words = U.word_costs(pages.select("html"))
    monkeypatch.setattr(U, "word_costs", lambda _: words)  # only the tokens' share is under test
    whole = scores()
    monkeypatch.setattr(U, "LEAST_SHARE", 0.2)
    assert "h:warez" in U.bayes_weights(tokens)[0] and {r.token for r in U.bayes_weights(tokens)[1].collect()} == {"h:crack", "p:get"}
    assert scores() == whole and len(whole) == len(rows)


def test_names_are_segmented():
    costs = {w: 3.0 for w in ("cheap", "pills", "online", "on", "line")}
    assert U.viterbi_words("cheappillsonline", costs, 12.0) == ["cheap", "pills", "online"]
    assert U.viterbi_words("", costs, 12.0) == []
    assert "".join(U.viterbi_words("qzx" * 40, costs, 12.0)) == "qzx" * 40


def test_odd_urls(spark):
    urls = [None, "", "no scheme/x", "HTTP://WWW.Example.COM/en/Ä?q", "a://b.net/es/x://c.com/", "x://example.com", "x://net/fr/#z", "x://notexample.com/en/", "x://spam-shop.org/buy", "x://spam-shop.org/buy", "://#"]
    rows = [(i, u, None if i % 2 else "<p>spam shop words</p>", "h") for i, u in enumerate(urls)] + [(None, "x://spamshop.org/", "x" * 200_000, "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.filter_urls(pages).collect()}
    assert [got[i][:3] for i in range(8)] == [
        ("", "", None), ("", "", None), ("", "", None), ("www.example.com", "/en/Ä", "www.example.com/en/"), ("b.net", "/es/x://c.com/", "net/es/"), ("example.com", "", None), ("net", "/fr/", "net/fr/"), ("notexample.com", "/en/", "com/"),
    ]
    assert got[3][3] == "allow" and got[4][3] == "block" and got[8][3] == got[9][3] == got[None][3] == "block" and got[0][3] == "allow"
    assert U.filter_urls(pages.where("false")).count() == 0
    twice = U.filter_urls(pages.unionAll(pages)).collect()
    assert len(twice) == 2 * len(rows) and {(r.page_id, r.host, r.path, r.rule) for r in twice} == {(i, *x[:3]) for i, x in got.items()}
    assert all(sum(r.page_id == i for r in twice) == 2 for i in got)
    assert pages.select(*U.url_parts("url")).where(F.lit(True)).count() == len(rows)
