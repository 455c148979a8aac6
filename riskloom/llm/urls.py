"""URL filters: host and path rules, then segmented host and path words under multinomial naive Bayes."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import materialize, maybe_broadcast
from riskloom.llm.decontaminate import words as text_words

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with the rule's.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

#: Names by topic to fit the classifier with, those to be blocked and others.
BLOCK_EXAMPLES = {
    "gambling": "online casino | casino bonus codes | casino slots | best casino | mobile casino games | live casino roulette | slots jackpot | free slots | poker slots | video poker | texas holdem poker | online poker room | sports betting odds | betting tips | football bets | live bets | bets bonus | online betting | casino roulette wheel | blackjack casino | bingo jackpot | bingo lottery | online lottery | lottery jackpot winner | gambling slots | online gambling",
    "drugs": "viagra online | buy viagra | generic viagra | cheap viagra | buy cialis | generic cialis | diet pills | sleeping pills | weight loss pills | buy pills online | cheap meds | generic meds | online pharmacy | cheap pharmacy | buy xanax | cheap tramadol | buy tramadol online | buy xanax online | miracle pills | miracle diet cure",
    "adult": "xxx videos | free xxx | xxx porn | porn tube | free porn videos | porn videos | adult webcams | adult sex chat | adult videos | adult toys | free adult dating | live sex | sex chat | sex videos | nude girls | hot nude girls | nude cams | sexy escorts | sexy girls | hot escorts | sex cams | girls cams | escorts dating | adult tube",
    "spam": "spam blast | bulk spam | spam mailer | seo spam | bulk mailer | link farm | seo links | seo backlinks | link exchange | buy links | buy backlinks | cheap backlinks | bulk links | seo link wheel | traffic exchange | buy traffic | cheap traffic | bulk seo traffic | spam links",
    "advertising": "popup ads | banner ads | popup banner | ad server | ads server | ads exchange | ad exchange | ad click tracker | click tracker | pixel tracker | tracker pixel | click ads | popup ad | pixel ads | ad pixel | ads click | banner tracker | ad banner | track clicks | track users | click track pixel",
    "scams": "payday loan | payday cash | quick cash loan | quick payday loan | fast cash | get rich quick | get rich | earn money fast | fast money | quick money | free iphone winner | free prize winner | prize winner claim | claim prize | crypto giveaway | bitcoin giveaway | double bitcoin | double crypto | replica watches | fake watches | replica rolex | fake rolex | replica bags",
    "malware": "cracked software | cracked games | warez keygen | warez download | keygen crack | serial crack | crack keygen serial | torrent warez | torrent crack | phishing login | phishing verify | verify login | malware download | malware dropper | botnet malware | hack keygen | trojan malware | trojan dropper | botnet trojan",
    "bettors": "win bets | bet win | big win bets | bet odds | crypto casino | bitcoin casino | bitcoin bets | lotto winner | lotto jackpot | online slots | free spins | spins bonus | bookmaker bonus | bookie tips | betting bonus | casino vip | vip slots",
    "doping": "steroids for sale | buy steroids | cheap steroids | steroids shop | anabolic steroids | steroid shop | pills for sale | buy meds online | no prescription meds | no prescription pills | opioids for sale | buy oxycodone | cheap xanax | buy weed online | weed for sale | fat burner pills | male enhancement pills | potency pills",
    "leaks": "onlyfans leaks | leaks xxx | leaked nudes | nudes videos | leaked porn | leaked videos xxx | nude leaks | nudes | nude pics | naked girls | naked pics | erotic stories | erotic massage | fetish videos | hentai porn | milf porn | teen porn | gay porn | amateur porn | porn star | sex tapes | sex shop | adult hookup",
    "frauds": "make money fast | make money online | payday advance | fake passports | fake diploma | buy diploma | fake id | counterfeit money | hack accounts | hacked accounts | password hack | free followers | buy followers | buy likes | buy reviews | fake reviews | ponzi crypto | crypto doubler",
    "plain": "casino blog | betting blog | sex blog | adult blog | spam blog | casino page | porn page | porn category page | betting home page | casino home page | spam feed | pills shop | viagra shop | shop replica | casino mobile | betting mobile | mobile porn | porn index | escorts contact | porn archive | casino forum | casino review",
}
ALLOW_EXAMPLES = {
    "news": "daily news | city news | city news today | world news | world press | daily press | evening news | evening times | city times | weather report | weather today | sports news | sports report | football news | football league | league results | sports results | election report | election results | business journal | business news | city events | local events | local news | local weather",
    "learning": "university library | city library | university press | science journal | science news | science museum | history museum | history journal | math lessons | language lessons | music lessons | online lessons | online course | math course | language course | language school | music school | school library | school teacher | math teacher | research papers | research journal | university research | adult education | education research | online education | wiki history | science wiki",
    "software": "open source | open source code | source code | python code | python docs | code docs | developer docs | developer guide | python developer | data archive | open data | data science | software docs | software developer | free software | open software | software download | help center | data center | support center | support forum | developer forum | web server docs | web developer | web server setup | click handler docs | track changes guide",
    "home": "recipe kitchen | home kitchen | kitchen garden | home garden | garden guide | travel guide | city travel | family travel | family health | health guide | health center | pet care | child care | health care | craft guide | home craft | family recipe | farm market | farm produce | track and field | cash flow | home loan | loan calculator | bank account | family dating history",
    "culture": "photo album | photo gallery | art gallery | art museum | book club | book review | movie review | movie guide | music album | music review | music video | video lecture | music festival | art festival | film festival | film review | championship win | win championship | poetry book | game design | game review | comic book | photo archive | music archive | film archive",
    "shops": "best buy | best shop | best books | book store | online store | online shop | shoe store | toy store | gift shop | gift cards | gift ideas | cheap flights | cheap hotels | hotel deals | flight deals | last minute deals | free shipping | free returns | discount code | buy books | buy tickets | cheap books | quick delivery | fast delivery | home delivery",
    "play": "card games | card game rules | board games | game rules | chess club | chess online | kids games | free games | mobile games | video games | game store | puzzle games | word games | game night | sports club | live sports | live scores | live music | live stream | mobile app | free apps | world cup | club results",
    "study": "adult literacy | adult learning | adult classes | literacy program | reading list | linked list | linked data | data structures | list of birds | word list | to do list | mailing list | email list | sex education | health education | drug safety | drug research | drug prevention | medical journal | medical news | pharmacy school | hospital pharmacy | vitamin guide | sleep guide | diet plan | healthy diet",
    "work": "job search | find jobs | job offers | online banking | bank login | account login | user login | web mail | web hosting | web design | credit union | credit report | personal finance | mortgage loan | student loan | car loan | home insurance | crypto news | bitcoin wallet | stock market | traffic report | traffic news | link building guide | live traffic | network security | password manager | virus research | antivirus",
    "plain": "index | index page | home | home page | about | about page | contact | contact page | article | article page | article archive | post | blog post | blog | blog archive | news blog | page | category | category page | category index | feed | blog feed | news feed | mobile | mobile page | shop | shop page | product | product page | product category | company | about company | company news | community | community forum | community blog | account settings | account page | free samples | product samples",
}

#: Common English words, each as likely as the others, besides those that texts give.
COMMON_WORDS = """
the and for you are not all new more home page this about how out time get use one up over net web site online best top big hot live now day world life
free win buy cheap shop store sale deal offer price money cash bank card loan fast quick easy rich job work earn club zone hub spot land city house
car auto game games play player toy kids baby girl boy man men woman women love heart dating date chat cam video photo pics image music great super
movie film tv radio news daily post times press blog forum wiki guide tips help support info data code soft app apps mobile phone tech digital my your
health med meds pill drug drugs diet weight loss fit doctor care beauty hair skin food cook kitchen garden travel trip tour hotel flight sport ball team
list linked links adult literacy steroids nude naked leaks fans only sex porn casino poker buy best for sale flights rules
bet bets slot fake crack watch hack spam farm link links ads ad track pixel school learn class book art history science green energy solar water earth
"""
#: Half of a word's share comes from the fixed words, half from the texts.
FIXED_SHARE = 0.5
#: What a run of letters that no word accounts for costs: once, and for each letter (natural logarithms).
UNKNOWN, UNKNOWN_LETTER = 14.0, 3.3
#: Words are looked up by so many first letters.
KEY_LETTERS = 20
#: Starts of a name whose substrings are made at once.
_STARTS = 5000
#: Share of blocked URLs before any word is seen, so that unknown words alone never block; count added to every word.
PRIOR_BLOCK, SMOOTHING = 0.3, 0.2


def _words_of(names: Mapping[str, str]) -> list[str]:
    return [w for topic in names.values() for w in topic.replace("|", " ").split()]


FIXED_WORDS = frozenset([*COMMON_WORDS.split(), *_words_of(BLOCK_EXAMPLES), *_words_of(ALLOW_EXAMPLES)])


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule (host and path together) that fits, as text without the verdict, and its verdict; nulls if none."""
    name = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):  # the last that fits wins
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


class Segmenter:
    """Splits run-together names into the likeliest sequence of words under a unigram model.

    ``shares`` holds the model's words within the names to split and their shares. A run of letters that no word
    accounts for costs ``UNKNOWN`` and ``UNKNOWN_LETTER`` a letter. Of equally likely splits the one with the longer last word is taken,
    a word before an unknown run. Every word length counts; the time is the name's length times the number of known words' lengths.
    """

    def __init__(self, shares: Mapping[str, float]):
        self.cost = {w: -math.log(p) for w, p in shares.items() if p > 0}
        self.lengths = sorted({len(w) for w in self.cost}, reverse=True)

    def split(self, name: str) -> list[str]:
        best, back = [0.0], [0]  # cost of the first i letters, where the last piece starts
        run, run_start = math.inf, 0  # cost with an unknown run at the end, where that starts
        for i in range(1, len(name) + 1):
            opened = best[i - 1] + UNKNOWN + UNKNOWN_LETTER
            run, run_start = (run + UNKNOWN_LETTER, run_start) if run + UNKNOWN_LETTER <= opened else (opened, i - 1)
            least, start = math.inf, 0
            for n in self.lengths:
                if n <= i and (c := self.cost.get(name[i - n : i])) is not None and best[i - n] + c < least:
                    least, start = best[i - n] + c, i - n
            if run < least:
                least, start = run, run_start
            best.append(least)
            back.append(start)
        out, i = [], len(name)
        while i:
            out.append(name[back[i] : i])
            i = back[i]
        return out[::-1]


class TokenClassifier:
    """Multinomial naive Bayes over the words of labelled names, with a small count added to each word.

    Single letters and words that no name has say nothing.
    """

    def __init__(self, examples: Sequence[tuple[str, bool]] | None = None, prior: float = PRIOR_BLOCK):
        counts: list[dict[str, int]] = [{}, {}]
        for name, blocked in EXAMPLES if examples is None else examples:
            for w in name.split():
                if len(w) > 1:
                    counts[blocked][w] = counts[blocked].get(w, 0) + 1
        words = counts[0].keys() | counts[1].keys()
        totals = [sum(c.values()) + SMOOTHING * len(words) for c in counts]
        self.odds = {w: math.log((counts[1].get(w, 0) + SMOOTHING) / totals[1]) - math.log((counts[0].get(w, 0) + SMOOTHING) / totals[0]) for w in words}
        self.prior = math.log(prior / (1 - prior))

    def weight(self, words: Sequence[str]) -> float:
        return math.fsum(self.odds.get(w, 0.0) for w in words)

    def score(self, words: Sequence[str]) -> float:
        return self.prior + self.weight(words)


#: The fixed names with their label.
EXAMPLES = [(name.strip(), blocked) for blocked, topics in ((True, BLOCK_EXAMPLES), (False, ALLOW_EXAMPLES)) for names in topics.values() for name in names.split("|")]


def word_shares(texts: DataFrame | None, like: DataFrame) -> DataFrame:
    """``(key, word, share)``, the unigram model: fixed words, and every word of ``texts (text)`` that is letters a-z alone, as often as they have it.

    Words are those of running text, which white space and marks part; names in URLs are no evidence for themselves.
    """
    fixed = like.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, sorted(FIXED_WORDS)))).alias("word"))
    if texts is None:
        return fixed.select(F.substring("word", 1, KEY_LETTERS).alias("key"), "word", F.lit(1 / len(FIXED_WORDS)).alias("share"))
    counted = texts.select(F.explode(text_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("word").rlike("^[a-z]+$"))
    counted = materialize(counted, "word-counts")
    total = counted.agg(F.sum("n")).first()[0]
    of_fixed, of_texts = (FIXED_SHARE, 1 - FIXED_SHARE) if total else (1.0, 0.0)
    share = F.coalesce(F.col("fixed"), F.lit(0.0)) + F.coalesce("n", F.lit(0)) * F.lit(of_texts / (total or 1))
    both = counted.join(F.broadcast(fixed.withColumn("fixed", F.lit(of_fixed / len(FIXED_WORDS)))), "word", "full")  # a fixed list
    return both.select(F.substring("word", 1, KEY_LETTERS).alias("key"), "word", share.alias("share"))


def split_tokens(tokens: DataFrame, shares: DataFrame, classifier: TokenClassifier) -> DataFrame:
    """``(token, words, weight)`` of distinct ``tokens (token)``: the split by spaces and its part of the log odds.

    The unigram model has no cap: each name meets the model's words among its own substrings in a join, so no process
    holds the whole model. Words are met by their first ``KEY_LETTERS`` letters, so a name may get a word that
    begins like a part of it and goes on otherwise; the search never finds that one. Substrings travel with a hash of their name, never
    with the name: what a name of n letters sends is n times ``KEY_LETTERS`` short keys.
    """

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, token in zip(batch["name"], batch["token"], strict=True):
                for at in range(0, len(token), _STARTS):
                    found = {token[i : i + k] for i in range(at, min(at + _STARTS, len(token))) for k in range(1, min(KEY_LETTERS, len(token) - i) + 1)}
                    yield pd.DataFrame({"key": list(found)}).assign(name=name)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [[t] if k is None else Segmenter(dict(zip(k, p, strict=True))).split(t) for t, k, p in zip(batch["token"], batch["known"], batch["shares"], strict=True)]
            yield pd.DataFrame({"token": batch["token"], "words": [" ".join(w) for w in found], "weight": [classifier.weight(w) for w in found]})

    named = tokens.select("token", F.md5("token").alias("name"))
    known = named.mapInPandas(keys, "key string, name string").join(maybe_broadcast(shares, _bytes("key", "word")), "key")
    known = known.groupBy("name").agg(F.collect_set(F.struct("word", "share")).alias("known")).select("name", F.col("known.word").alias("known"), F.col("known.share").alias("shares"))
    return named.join(known, "name", "left").select("token", "known", "shares").mapInPandas(work, "token string, words string, weight double")


def _bytes(*columns: str) -> str:
    """Weight of a row for ``maybe_broadcast``: 1 for a short key, more for long texts."""
    return "1 + (" + " + ".join(f"octet_length({c})" for c in columns) + ") div 32"


def judge_urls(pages: DataFrame, texts: DataFrame | None = None, *, rules: Sequence[tuple[str, str, str]] = RULES, examples: Sequence[tuple[str, bool]] | None = None) -> DataFrame:
    """Allow or block every url of ``pages (page_id, url, ...)``.

    The longest rule that fits decides. Else host and path tokens (runs of letters a-z, lower-cased), split into words
    by a unigram model of fixed words and of all words of ``texts (text, ...)``, are scored by naive Bayes, fitted to
    labelled names ``examples`` (name, blocked); log odds above 0 block. How often a name occurs among the urls
    changes nothing.

    Returns one row per input row: ``page_id, host, path, rule`` (null if none), ``verdict, words`` (the split
    words, by spaces), ``score`` (log odds; both also where a rule decides). Null urls and urls without ``://`` have
    empty host and path and are judged like others. Null ids and repeated rows are kept; other columns are ignored; an
    empty table gives an empty result. Urls and names of any length are taken whole. Null texts have no words; without
    texts the fixed words alone are the model. Ties between splits: see ``Segmenter``.
    """
    classifier = TokenClassifier(examples)
    base = materialize(pages.select(F.col("page_id").cast("bigint"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), "urls")
    urls = base.select("host", "path").distinct()
    pieces = F.filter(F.split(F.lower(F.concat_ws(" ", "host", "path")), "[^a-z]+"), lambda x: x != "")
    placed = materialize(urls.select("host", "path", F.posexplode_outer(pieces).alias("pos", "token")), "url-tokens")
    tokens = placed.select("token").where("token is not null").distinct()
    splits = materialize(split_tokens(tokens, materialize(word_shares(texts, pages), "word-shares"), classifier), "url-splits")
    each = placed.join(maybe_broadcast(splits, _bytes("token", "words")), "token", "left")
    per_url = each.groupBy("host", "path").agg(F.array_sort(F.collect_list(F.struct("pos", "words", "weight"))).alias("placed"))
    score = F.aggregate("placed", F.lit(classifier.prior), lambda a, x: a + F.coalesce(x["weight"], F.lit(0.0)))
    scored = base.join(per_url.select("host", "path", F.concat_ws(" ", F.col("placed.words")).alias("words"), score.alias("score")), ["host", "path"])
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("score") > 0, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "words", "score")


#: Host, path and the rule of every page, and the rule's verdict; the method's verdict is beyond SQL.
RULES_SQL = """
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(verdict, h, p) AS (VALUES {rules})
SELECT page_id, host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
FROM u LEFT JOIN r ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL
""".format(rules=", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES))
