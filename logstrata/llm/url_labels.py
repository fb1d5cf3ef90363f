"""A labelled table of invented URLs, from which the URL filter learns, made by a rule from two lists of words.

Each word stands in several hosts, beside words a fixed number of places on, so that a
host that is held out is made of words that others have. No host is taken from a crawl.
"""

from __future__ import annotations

#: Subjects of hosts that a crawl should not keep, and of those that it should.
BAD = "casino poker slots jackpot roulette bingo bets betting wager lottery viagra cialis pills pharmacy meds steroids spam seo backlinks linkfarm ads popup tracker clicks banners adult porn xxx sex cams nude escort payday loans fastcash crack keygen warez torrent serials phishing malware replica prize winner giveaway cheap free win".split()
GOOD = (
    "news weather garden library museum university school history physics mathematics chemistry biology astronomy geology poetry novel theatre concert orchestra painting sculpture cinema travel railway harbour airport hospital clinic recipes kitchen bakery orchard farmers forest river mountain island parliament council townhall court journal archive handbook manual compiler kernel "
    "database science health sports football cycling chess language dictionary grammar festival market craft pottery weaving carpenter engineer bridge energy climate ocean birds insects"
).split()
#: Words that either kind of host has.
NEUTRAL = "new old online today world my the city club blog".split()
_SCHEMES, _FRONTS, _PATHS = ("http://", "https://"), ("", "www.", "m.", "blog."), ("/en/{}", "/fr/{}?page=2", "/de/{}.html", "/es/{}/", "/", "/en/{}#top", "/{}", "/de/{}?utm_source=feed", "/news/{}")


def rows(words: list[str], top: str = "test") -> list[str]:
    """Six URLs for each word: alone, beside neutral words, and beside or run together with words of its list."""
    found = []
    for i, word in enumerate(words):
        near, far = words[(i + 7) % len(words)], words[(i + 19) % len(words)]
        hosts = (word, f"{NEUTRAL[i % len(NEUTRAL)]}-{word}", f"{word}-{NEUTRAL[(i + 3) % len(NEUTRAL)]}", f"{word}-{near}", f"{far}{word}", f"{word}{NEUTRAL[(i + 6) % len(NEUTRAL)]}")
        for j, host in enumerate(hosts):
            n = 6 * i + j
            found.append(_SCHEMES[n % 2] + _FRONTS[n // 2 % 4] + host + "." + top + _PATHS[n % len(_PATHS)].format(7 * n % 31))
    return found


BLOCK, ALLOW = rows(BAD), rows(GOOD)
