"""Rule packs: word lists and site facts turned into Column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.base import any_of, built_once, col, escape, text_or_empty
from . import fixed_values as V


@dataclass(frozen=True)
class RulePack:
    """Everything the classifiers consult.  Replace any field to use your own rules."""
    relevance: list = field(default_factory=lambda: V.RELEVANCE)
    ai_words: list = field(default_factory=lambda: V.AI_WORDS)
    government_words: list = field(default_factory=lambda: V.GOVERNMENT_WORDS)
    finance_words: list = field(default_factory=lambda: V.FINANCE_WORDS)
    dual_carbon_words: list = field(default_factory=lambda: V.DUAL_CARBON_WORDS)
    industry_words: list = field(default_factory=lambda: V.INDUSTRY_WORDS)
    policy_weak_words: list = field(default_factory=lambda: V.POLICY_WEAK_WORDS)
    strength: dict = field(default_factory=lambda: V.STRENGTH_TIERS)
    topic_tiers: list = field(default_factory=lambda: V.TOPIC_TIERS)
    regions: list = field(default_factory=lambda: V.REGIONS)
    topics: list = field(default_factory=lambda: V.TOPIC_TAGS)
    document_types: list = field(default_factory=lambda: V.DOCUMENT_TYPES)
    people: list = field(default_factory=lambda: V.PEOPLE)
    role_tiers: list = field(default_factory=lambda: V.ROLE_TIERS)
    site_dimension: dict = field(default_factory=dict)
    # False: every word matches inside other words too; True: short Latin words stand alone
    strict_words: bool = False


TITLE_L, TEXT_L = "_title_l", "_text_l"


def lowered(df: DataFrame) -> DataFrame:
    """Add the lower-cased title and title-plus-summary the word tests look at."""
    summary = text_or_empty("summary") if "summary" in df.columns else F.lit("")
    return df.withColumns({TITLE_L: F.lower(text_or_empty("title")),
                           TEXT_L: F.lower(F.concat_ws(" ", text_or_empty("title"), summary))})


def _contains_any(words) -> str:
    """One literal array instead of one expression per word keeps plans small."""
    quoted = ("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words)
    return f"exists(array({', '.join(quoted)}), w -> contains(t, w))"


def has_word(where: str, words, short: int = 0, border: str = "[^a-z]", any_ascii: bool = False) -> Column:
    """Does the lower-cased text column hold one of the words?

    Latin words of at most ``short`` letters must stand alone.  Plain substring tests
    run first (they are many times cheaper than one long alternation), so the pattern
    with the borders is only tried on texts that hold such a word at all.  The text is
    named once: a filter pushed below the projection would otherwise rebuild it per word.
    """
    lower = [w.lower() for w in words]
    alone = [w for w in lower if w.isascii() and len(w) <= short and (any_ascii or w.isalpha())]
    free = [w for w in lower if w not in alone]
    parts = [_contains_any(free)] if free else []
    if alone:
        pattern = f"(?:^|{border})(?:{'|'.join(escape(w) for w in alone)})(?:{border}|$)"
        parts.append(f"({_contains_any(alone)} AND t RLIKE r'{pattern}')")
    test = " OR ".join(parts) if parts else "false"
    return F.expr(f"get(transform(array({where}), t -> {test}), 0)")


WORD_BORDER = r"[^\p{L}\p{N}_]"


def registry(spark: SparkSession) -> DataFrame:
    """The source registry: one row per site (a fixed list of 70)."""
    rows = []
    for rank, line in enumerate(V.SITES.strip().splitlines()):
        site, name, library, group, score, region, klass, category = line.split("|")
        window = "slow" if site in V.SITES_SLOW else "weekly" if site in V.SITES_WEEKLY else "default"
        rows.append((site, name, library, group, int(score), region, klass, category,
                     V.WINDOW_HOURS[window], rank))
    return spark.createDataFrame(
        rows, "site_id string, site_name string, library string, grp string, authority int, home_region string, "
              "site_class string, category string, window_hours int, site_rank int")


@built_once
def is_relevant(url="url", site_class="site_class", pack: RulePack = RulePack()) -> Column:
    """First test that applies to the site's class decides (needs ``lowered``)."""
    short = 4 if pack.strict_words else 0
    word_hit = has_word(TEXT_L, pack.relevance, short) | has_word(TEXT_L, pack.ai_words, short)
    title_hit = has_word(TITLE_L, pack.relevance, 4, WORD_BORDER, any_ascii=True)
    u = F.lower(text_or_empty(url))
    url_hit = ~u.contains(V.AGGREGATOR_HOST) & has_word(f"lower(coalesce({url}, ''))", pack.relevance, short)
    klass = F.coalesce(col(site_class), F.lit("keyword"))
    return (F.when(klass.isin("green", "ai", "robot"), F.lit(True))
            .when(klass.isin("tech", "ai_media", "social"), word_hit)
            .otherwise(title_hit | url_hit))


@built_once
def dimension(site_id="site_id", library="library", site_class="site_class", pack: RulePack = RulePack()) -> Column:
    """One of the four views of an item; first match in this order (needs ``lowered``)."""
    short = 4 if pack.strict_words else 0
    klass = F.coalesce(col(site_class), F.lit("keyword"))
    chain = F
    for site, dim in pack.site_dimension.items():
        chain = chain.when(col(site_id) == site, F.lit(dim))
    return (chain.when(klass == "ai", F.lit(V.DIM_AI))
            .when((klass == "tech") & has_word(TEXT_L, pack.ai_words, short), F.lit(V.DIM_AI))
            .when(klass == "tech", F.lit(V.DIM_INDUSTRY))
            .when(has_word(TITLE_L, pack.government_words, short), F.lit(V.DIM_POLICY))
            .when(has_word(TEXT_L, pack.finance_words, short), F.lit(V.DIM_MARKET))
            .when(has_word(TEXT_L, pack.dual_carbon_words, short), F.lit(V.DIM_INDUSTRY))
            .when(has_word(TITLE_L, pack.ai_words, short) | has_word(TITLE_L, ["ai"], 2), F.lit(V.DIM_AI))
            .when(has_word(TEXT_L, pack.industry_words, short), F.lit(V.DIM_INDUSTRY))
            .when(col(library) == "policy", F.lit(V.DIM_POLICY))
            .when(has_word(TEXT_L, pack.policy_weak_words, short), F.lit(V.DIM_POLICY))
            .otherwise(F.lit(V.DIM_INDUSTRY)))


@built_once
def region(home_region="home_region", pack: RulePack = RulePack()) -> Column:
    """Region named in the title (first list wins), else the site's home, else international."""
    chain = F
    for name, words in pack.regions:
        chain = chain.when(has_word(TITLE_L, words), F.lit(name))
    return chain.otherwise(F.coalesce(F.nullif(col(home_region), F.lit("")), F.lit(V.DEFAULT_REGION)))


@built_once
def topics(pack: RulePack = RulePack()) -> Column:
    """Every topic tag whose words hit the title, in rule order (needs ``lowered``)."""
    return F.array_compact(F.array(*[F.when(has_word(TITLE_L, words, 3), F.lit(tag)) for tag, words in pack.topics]))


@built_once
def document_type(pack: RulePack = RulePack()) -> Column:
    chain = F
    for name, words in pack.document_types:
        chain = chain.when(has_word(TITLE_L, words), F.lit(name))
    return chain.otherwise(F.lit(V.DOCUMENT_TYPE_DEFAULT))


def tags(region_col, topics_col, type_col) -> Column:
    """Region, topics, document type; a fallback tag when there is no topic of its own."""
    r, ts, k = col(region_col), col(topics_col), col(type_col)
    own = F.filter(ts, lambda t: (t != r) & (t != k))
    extra = F.when(F.size(own) == 0, F.array(F.lit(V.DOCUMENT_TYPE_DEFAULT))) \
             .otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(r), ts, F.array(k), extra))


@built_once
def people(title, summary, body=None, pack: RulePack = RulePack(), body_chars: int | None = None) -> Column:
    """Known names in title, summary and body (its first ``body_chars`` characters, by default all), in list order."""
    parts = [text_or_empty(title), text_or_empty(summary)]
    if body is not None:
        parts.append(F.substring(text_or_empty(body), 1, body_chars) if body_chars else text_or_empty(body))
    text = F.concat_ws(" ", *parts)
    return F.when(text.rlike(any_of([n for n, _ in pack.people])),
                  F.array_compact(F.array(*[F.when(text.contains(n), F.lit(n)) for n, _ in pack.people]))) \
            .otherwise(F.array().cast("array<string>"))


def person_role(name, pack: RulePack = RulePack()) -> Column:
    chain = F
    for n, role in pack.people:
        chain = chain.when(col(name) == n, F.lit(role))
    return chain.otherwise(F.lit(""))


def role_points(role: str, pack: RulePack = RulePack(), exact_deputies: bool = False) -> int:
    """Points of a role text.  A deputy's title holds the senior title, so by default deputies
    earn the senior points; ``exact_deputies`` looks at the deputy list first."""
    tiers = pack.role_tiers
    if exact_deputies:
        tiers = [tiers[1], tiers[0], *tiers[2:]]
    return next((p for p, words in tiers if any(w in role for w in words)), 0)


@built_once
def people_score(people_col, pack: RulePack = RulePack(), exact_deputies: bool = False) -> Column:
    points = {n: role_points(r, pack, exact_deputies) for n, r in pack.people}
    names = col(people_col)
    chain = F
    for p in sorted(set(points.values()) - {0}, reverse=True):
        group = F.array(*[F.lit(n) for n, q in points.items() if q == p])
        chain = chain.when(F.arrays_overlap(names, group), F.lit(p))
    return chain.otherwise(F.lit(0)) if chain is not F else F.lit(0)


@built_once
def strength_score(dimension_col="dimension", pack: RulePack = RulePack()) -> Column:
    """Points of the first tier of the dimension's ladder that hits (needs ``lowered``)."""
    d, short = col(dimension_col), 4 if pack.strict_words else 0

    def ladder(tiers):
        chain = F
        for points, words in tiers:
            chain = chain.when(has_word(TEXT_L, words, short), F.lit(points))
        return chain.otherwise(F.lit(V.STRENGTH_DEFAULT))
    chain = F
    for name, tiers in pack.strength.items():
        if name != V.DIM_POLICY:
            chain = chain.when(d == name, ladder(tiers))
    return chain.otherwise(ladder(pack.strength[V.DIM_POLICY]))


@built_once
def topic_score(pack: RulePack = RulePack()) -> Column:
    chain = F
    for points, words in pack.topic_tiers:
        chain = chain.when(has_word(TEXT_L, words, 4 if pack.strict_words else 0), F.lit(points))
    return chain.otherwise(F.lit(V.TOPIC_DEFAULT))


def freshness_score(ts, as_of: Column) -> Column:
    hours = (F.unix_micros(as_of) - F.unix_micros(col(ts))) / 3.6e9
    chain = F.when(col(ts).isNull(), F.lit(V.FRESHNESS_UNKNOWN))
    for bound, points in V.FRESHNESS_STEPS:
        chain = chain.when(hours < bound, F.lit(points))
    return chain.otherwise(F.lit(V.FRESHNESS_OLD))


def level(score) -> Column:
    chain = F
    for bound, name in V.LEVELS:
        chain = chain.when(col(score) >= bound, F.lit(name))
    return chain.otherwise(F.lit(V.LEVEL_LOWEST))
