"""URL filter: allow and block rules, then a weighted vocabulary matched by an Aho-Corasick automaton."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import column

#: The vocabulary, in English, German, French and Spanish: one of the strict terms rejects a url.
STRICT = tuple(
    "adult casino escort escorts gambling hentai porn porno pornos viagra warez xxx cialis levitra slots blackjack roulette sexcam sexshop camgirl camgirls milf "
    "nude nudes erotic erotik erotique erotica fetish bdsm hardcore keygen keygens crackz torrentz phishing darknet replica rolex payday "
    "gluecksspiel wetten sportwetten hure huren nackt pornofilme potenzmittel paris-sportifs jeux-argent machines-a-sous pornographie escortes "
    "apuestas tragaperras ruleta prostitutas putas desnudas pastillas-azules".split()
)
#: As many different ones of these as ``soft_hits`` reject a url.
SOFT = tuple(
    "ads bets betting bonus cheap click farm free jackpot loan loans pills poker promo sex spam track win winner winners prize prizes lottery lotto bingo "
    "coupon coupons discount discounts deals offer offers sale dating hookup singles cams webcam webcams tracker popup popunder affiliate affiliates referral "
    "clickbait seo backlinks crypto bitcoin forex casino-bonus freespins weightloss diet pharmacy pharma drugs steroids hack hacks cheats crack cracked serial serials torrent torrents "
    "gratis kostenlos billig rabatt gutschein gewinnspiel gewinn kredit kredite spielautomat abnehmen apotheke werbung "
    "gratuit gratuits pascher promotions rabais concours loterie credit rencontres pharmacie publicite cadeau "
    "gratuito gratuitos barato baratos oferta ofertas descuento descuentos sorteo loteria prestamo prestamos citas farmacia publicidad regalo".split()
)
#: Terms of a vocabulary table, at most: it goes to every worker.
MOST_TERMS = 100_000
#: (allow, host and path), as in the contract of the query.
RULES = ((True, "com/"), (False, "example.com/en/"), (True, "www.example.com/en/"), (False, "net/es/"), (False, "net/fr/"))
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    if url is None:
        return "", ""
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    rest = rest.split("#", 1)[0].split("?", 1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


def vocabulary(terms: DataFrame, term_col: str = "term", weight_col: str = "weight") -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Strict and soft terms of a table: those of weight 1 or more reject a url alone, the others (null too) are soft.

    Terms are lower-cased (A-Z) and count once, with their highest weight; null and empty ones are left out.
    A table of more than MOST_TERMS terms is refused.
    """
    weights = terms.where(F.length(column(term_col)) > 0).groupBy(F.translate(column(term_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("term")).agg(F.max(column(weight_col)).alias("weight"))
    rows = weights.orderBy("term").limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"a vocabulary has {MOST_TERMS} terms at most")
    strict = tuple(r.term for r in rows if (r.weight or 0) >= 1)
    return strict, tuple(r.term for r in rows if (r.weight or 0) < 1)


@functools.lru_cache(maxsize=8)
def automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for words, is_strict in ((soft, False), (strict, True)):
        for word in words:
            found.add_word(word, (word, is_strict))
    found.make_automaton()
    return found


def _bounded(text: str, start: int, end: int) -> bool:
    edge = lambda c: not ("a" <= c <= "z" or "0" <= c <= "9")
    return (start == 0 or edge(text[start - 1])) and (end == len(text) or edge(text[end]))


def hits(url: str, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT) -> tuple[int, int]:
    """Numbers of different strict and soft terms that stand in the url between characters other than a-z, 0-9 (any case)."""
    text, seen = url.translate(_LOWER), set()
    for end, found in automaton(strict, soft).iter(text):
        if found not in seen and _bounded(text, end + 1 - len(found[0]), end + 1):
            seen.add(found)
    n = sum(is_strict for _, is_strict in seen)
    return n, len(seen) - n


def rule_for(host: str, path: str, rules: dict[str, list[tuple[str, bool]]]) -> tuple[str, bool] | None:
    """The longest rule whose host is the url's or a parent domain of it and whose path starts the url's."""
    best: tuple[str, bool] | None = None
    while True:
        for start, allow in rules.get(host, ()):
            if path.startswith(start) and (best is None or len(host) + len(start) > len(best[0])):
                best = host + start, allow
        dot = host.find(".")
        if dot < 0:
            return best
        host = host[dot + 1 :]


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Iterable[tuple[bool, str]] = RULES, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT, soft_hits: int = 2) -> DataFrame:
    """One row a page: (id, host, path, rule, verdict, strict_hits, soft_hits).

    The longest fitting rule decides; without one, a strict term or ``soft_hits`` different soft terms
    block the url.  A null url, or one without ``://``, has an empty host and path and fits no rule; the
    terms are still looked for.  Rows may repeat; every row gets its own result.
    """
    spark, table = pages.sparkSession, {}
    for allow, rule in rules:
        host, slash, path = rule.partition("/")
        table.setdefault(host, []).append((slash + path, allow))
    schema = f"`{id_col}` {dict(pages.dtypes)[id_col]}, host string, path string, rule string, verdict string, strict_hits int, soft_hits int"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                rule = rule_for(host, path, table)
                n_strict, n_soft = hits(url or "", strict, soft)
                block = not rule[1] if rule else n_strict >= 1 or n_soft >= soft_hits
                rows.append((host, path, rule and rule[0], "block" if block else "allow", n_strict, n_soft))
            host, path, rule, verdict, n_strict, n_soft = zip(*rows) if rows else ((),) * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.string()) for x in (host, path, rule, verdict)), *(pa.array(x, pa.int32()) for x in (n_strict, n_soft))], names=[id_col, "host", "path", "rule", "verdict", "strict_hits", "soft_hits"])

    return pages.select(column(id_col), column(url_col)).mapInArrow(judge, schema)
