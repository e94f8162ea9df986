"""Thresholds, term lists and host lists; every one can be replaced by a caller."""

from __future__ import annotations

import dataclasses

dataclass = dataclasses.dataclass


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.2
    b: float = 0.75


@dataclass(frozen=True)
class Topic:
    """What counts as on topic: one alternation over lower-cased text."""

    name: str = "t[üu]e?bingen"
    entities: tuple[str, ...] = tuple(
        sorted(
            "bebenhausen|chocolart|cyber valley|derendingen|eberhard karls|hagelloch|hölderlin|kupferbau|lustnau|neckarfront|"
            "neckarinsel|pfrondorf|schwärzloch|steinlach|stocherkahn|unterjesingen|wilhelmsstift|wurmlinger kapelle".split("|")
        )
    )

    @property
    def pattern(self) -> str:
        return "|".join((self.name, *self.entities))


@dataclass(frozen=True)
class PageGate:
    strong: float = 0.80
    index: float = 0.60


@dataclass(frozen=True)
class LinkGate:
    min_score: float = 0.35
    max_depth: int = 5
    per_host: int = 8
    per_family: int = 3
    languages: tuple[str, ...] = ("de", "en")


def _names(text: str) -> tuple[str, ...]:
    return tuple(sorted(text.split()))


@dataclass(frozen=True)
class LinkSkip:
    """Links that are never worth a model call."""

    suffixes: tuple[str, ...] = tuple("." + s for s in _names("css gif ico jpeg jpg js mp3 mp4 pdf png svg webp woff woff2 zip"))
    path_words: tuple[str, ...] = _names(
        "tags tag terms talk special sitemap search privacy newsletter logout login kontakt imprint impressum cookies cookie contact category appendix"
    )
    languages: tuple[str, ...] = _names("zh ru pt pl nl ja it fr es deutsch de cn")
    hosts: tuple[str, ...] = _names(
        "youtu.be youtube.com x.com twitter.com tiktok.com plus.google.com pinterest.de pinterest.com maps.google.de maps.google.com linkedin.com "
        "instagram.com www.google.de google.de www.google.com google.com facebook.com bsky.social bsky.app www.atlasobscura.com atlasobscura.com "
        "archive.ph archive.is archive.today web.archive.org"
    )
    host_suffixes: tuple[str, ...] = tuple("." + s for s in _names("youtube.com twitter.com tiktok.com pinterest.de pinterest.com linkedin.com instagram.com facebook.com atlasobscura.com"))


@dataclass(frozen=True)
class Frontier:
    depth_weight: float = 0.7
    host_weight: float = 0.9
    recent_weight: float = 1.0
    recent_hosts: int = 8
    pop_window: int = 128
    reject_cutoff: int = 6
    max_pages_per_host: int = 60


@dataclass(frozen=True)
class Noise:
    """Links of the labeling queue that only navigate."""

    hosts: str = (
        r"^((alma|epv-welt|exchange|fit|listserv|praxisportal|timms|webmail)\.uni-t[üu]e?bingen\.de|books\.google\.com|(developer|donate|stats)\.wikimedia\.org|"
        r"d-nb\.info|facebook\.com|(maps\.)?google\.com|google\.de|id\.loc\.gov|idref\.fr|instagram\.com|stay22\.com|viaf\.org|wikimediafoundation\.org|x\.com|youtube\.com|youtu\.be|tiktok\.com)$"
        r"|\.(toolforge|wmcloud|archive)\.org$|\.tiktok\.com$"
    )
    wiki: str = r"\.wikipedia\.org$"
    wiki_kept: tuple[str, ...] = ("en.wikipedia.org", "en.wikivoyage.org")
    url: str = r"/maps/|/login|logon|mailman/listinfo|hisinonestartpage\.faces|startsearch\.aspx"
    anchor: str = (
        r"^(back|barrierefreiheit|contact|contact us|deutsch|edit|english|facebook|home|imprint|instagram|kontakt|login|mehr|newsletter|search|share|sitemap|support|terms|to top|top|twitter|x)$"
        r"|cookie|privacy|datenschutz|impressum|spam prevention|^jump |^skip "
    )
    topic_url: str = r"tue?bingen"
    topic_anchor: str = r"t(ü|ue|u)bingen"
    topic_hosts: str = (
        r"\.uni-t[üu]e?bingen\.de$|^(bbc\.com|cyber-valley\.de|en\.wikivoyage\.org|gotouniversity\.com|hoelderlinturm\.de|hotelamschloss\.de|my-stuwe\.de|naturpark-schoenbuch\.de)$"
        r"|^kunsthalle-t[üu]e?bingen\.de$|^t[üu]e?bingenresearchcampus\.com$"
    )
    english_url: str = r"/en|english"
    english_hosts: tuple[str, ...] = ("en.wikivoyage.org", "en.wikipedia.org", "bbc.com")
    sources: tuple[str, ...] = ("crawler_link", "crawler_linkverdict", "curated_link")
