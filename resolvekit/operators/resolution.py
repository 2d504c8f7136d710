"""From claims, records and audits to an identity's outcome, and what keeps several profiles open.

An entity's claims say which ids it has with each provider. Providers: spotify (the stored id), musicbrainz (authority
records), discogs (profiles), wikidata. Everything is grouped by entity and joined by it; only titles that two catalogs
share are compared in pairs.

Tables, all keyed by entity and without rows where nothing is known:
    stored: external_id, the id that the entity has.
    claims: identifier_type, value, source, asserted_by, position (order in which they were read).
    authorities: id, artist_type, begin, homepages (array), urls (array). Authority records that were found.
    profiles: id, real_name, aliases (array of ids). Profiles that were found.
    catalogs: id, titles (array of title keys), releases (long). Catalogs of the authority records.
    retired: provider, id, state (deprecated or redirected).
    lookups: id. Authorities behind the exact URL of the stored id.
    audit: competitors (long), linked_ids (array of stored ids that entities of the same name link to).
    errors: provider. blocked: code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import id_from_url, name_key, reasons
from . import facts
from .numbering import shared_folder

#: Outcomes of an identity.
COHERENT, SAME_NAME = "coherent_identity_evidence", "coherent_identity_with_same_name_ambiguity"
MULTIPLICITY, INSUFFICIENT = "provider_profile_multiplicity", "insufficient_corroboration"
SEMANTIC, UNRESOLVED, CONFLICTING = "semantic_identity_conflict", "unresolved_identity", "conflicting_identity"
#: What a conflict is taken for.
REDIRECTED, DEPRECATED, OPEN = "merged_or_redirected_profile", "deprecated_or_obsolete_identifier", "unresolved_multiplicity"
#: Relations of names that explain several profiles of one person.
LEGAL_RELATIONS = ("legal_name_stage_name", "legal_name_alias")
#: Where an id stands in a URL of an authority record.
RECORD_URLS = {
    "spotify": r"^https://open\.spotify\.com/artist/([A-Za-z0-9]{22})(?:[/?#]|$)",
    "discogs": r"(?i)^https?://(?:www\.)?discogs\.com/(?:[a-z]{2}/)?artist/([1-9][0-9]*)(?:[-/?#]|$)",
    "wikidata": r"(?i)^https?://www\.wikidata\.org/wiki/(Q[1-9][0-9]*)(?:[/?#]|$)",
}
NONE = "cast(array() as array<string>)"
TABLES = ("stored", "claims", "authorities", "profiles", "catalogs", "retired", "lookups", "audit", "errors", "blocked")


def gather_claims(stored: DataFrame, claims: DataFrame, authorities: DataFrame, profiles: DataFrame, lookups: DataFrame) -> DataFrame:
    """(entity, identifier_type, value, source, asserted_by, position): the given claims and those that the records make.

    The stored id comes first (source stored), then the given claims, those of authority records and their URLs, those
    of profiles, and the authority behind the exact URL if it is the only one. A claim made twice is there twice.
    """
    null, at = F.lit(None).cast("string"), lambda n: F.struct(F.lit(n).alias("a"), F.col("position").cast("long").alias("b"), F.lit("").alias("c"))
    by = lambda n, id_: F.struct(F.lit(n).alias("a"), F.lit(0).cast("long").alias("b"), F.col(id_).cast("string").alias("c"))
    row = lambda df, kind, value, source, who, place: df.select("entity", kind.alias("identifier_type"), F.col(value).cast("string").alias("value"), source.alias("source"),
        who.alias("asserted_by"), place.alias("position"))
    own = row(stored, F.lit("spotify"), "external_id", F.lit("stored"), null, by(0, "external_id"))
    given = row(claims, F.col("identifier_type"), "value", F.col("source"), F.col("asserted_by").cast("string"), at(1))
    records = row(authorities, F.lit("musicbrainz"), "id", F.lit("musicbrainz"), F.col("id"), by(2, "id"))
    found = F.explode(F.array(*(F.struct(F.lit(k).alias("identifier_type"), id_from_url("url", p).alias("value")) for k, p in RECORD_URLS.items())))
    urls = authorities.select("entity", "id", F.explode("urls").alias("url")).select("entity", "id", found.alias("f")).select("entity", "id", "f.*")
    linked = row(urls, F.col("identifier_type"), "value", F.lit("musicbrainz"), F.col("id"), by(2, "id"))
    profile = row(profiles, F.lit("discogs"), "id", F.lit("discogs"), F.col("id"), by(3, "id"))
    one = lookups.groupBy("entity").agg(F.min("id").alias("id"), F.max("id").alias("_last")).where("id = _last")
    exact = row(one, F.lit("musicbrainz"), "id", F.lit("musicbrainz"), F.col("id"), by(4, "id"))
    return own.unionByName(given).unionByName(records).unionByName(linked).unionByName(profile).unionByName(exact).where("value is not null")


def mutual_links(links: DataFrame) -> DataFrame:
    """(entity, mutual) of links(entity, id, others array): whether a group's ids all name each other.

    Of a group of n ids that is n * (n - 1) directed links within it; ids are counted once, links out of it aren't.
    """
    ids = links.groupBy("entity", "id").agg(F.array_distinct(F.flatten(F.collect_list(F.coalesce("others", F.expr(NONE))))).alias("others"))
    size = ids.groupBy("entity").agg(F.count("*").alias("n"))
    edges = ids.select("entity", "id", F.explode("others").alias("other")).where("other <> id")
    inside = edges.join(ids.select("entity", F.col("id").alias("other")), ["entity", "other"]).groupBy("entity").agg(F.count("*").alias("k"))
    return size.join(inside, "entity", "left").select("entity", ((F.col("n") > 1) & (F.coalesce("k", F.lit(0)) == F.col("n") * (F.col("n") - 1))).alias("mutual"))


def shared_titles(catalogs: DataFrame) -> DataFrame:
    """(entity, left_id, right_id, overlap) of catalogs(entity, id, titles): pairs that share a title, counted at the title."""
    from .catalog import pairwise_overlap

    titles = catalogs.select(F.col("entity").alias("group_id"), F.col("id").alias("profile_id"), F.explode("titles").alias("title"))
    return pairwise_overlap(titles).withColumnRenamed("group_id", "entity")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _fact_rows(t: dict[str, DataFrame], claims: DataFrame, relations: DataFrame | None) -> list[DataFrame]:
    """Rows of the tables as facts.ROWS has them, one for each row of a table."""
    none, of = F.lit(None).cast("string"), lambda *c: F.array(*(x.cast("string") for x in c))
    row = lambda df, kind, flags=0, id=none, more=None, numbers=0: df.select("entity", (F.lit(kind).cast("long") + facts.FLAG * flags + numbers).alias("code"), id.cast("string").alias("id"),
        (F.lit(None) if more is None else more).cast("array<string>").alias("more"))
    bit = lambda c, n=1: F.when(c, n).otherwise(0)
    given = lambda c: F.coalesce(c != "", F.lit(False))

    def place(c, names):
        out = F.lit(len(names))
        for i, name in reversed([*enumerate(names)]):
            out = F.when(F.col(c) == name, i).otherwise(out)
        return out

    def numbers(a, b):
        """Whether two numbers are too large for a code, and what they are in it."""
        far = ~F.coalesce((a >= 0) & (a < facts.NUMBER // facts.FIRST), F.lit(False)) | F.coalesce((b < 0) | (b >= 1 << 46), F.lit(False))
        return far, F.when(far, facts.FAR).otherwise(F.lit(facts.FIRST) * a + F.when(b.isNull(), facts.NULL).otherwise(F.lit(facts.NUMBER) * b))

    # an authority that makes a claim of a profile or stored id says it
    said = F.when((F.col("source") == "musicbrainz") & F.col("identifier_type").isin("discogs", "spotify"), F.col("asserted_by")).cast("string")
    at = F.col("position").cast("struct<a:int,b:bigint,c:string>")
    far, number = numbers(at["a"], at["b"])
    text = F.when(far, facts.SECOND).when(at["c"].isNull(), facts.NOTHING).when(at["c"] == "", facts.EMPTY).when(at["c"] == F.col("value"), facts.SAME).otherwise(facts.SECOND)
    more = F.when(far, of(said, at["c"], at["a"], at["b"])).when(text == facts.SECOND, of(said, at["c"])).when(said.isNotNull(), of(said))
    claim = place("identifier_type", facts.PROVIDERS) + facts.SOURCE // facts.FLAG * place("source", facts.SOURCES)
    key, linked, named, some = name_key("real_name"), F.coalesce("linked_ids", F.expr(NONE)), F.col("real_name"), lambda c: F.coalesce(c, F.expr(NONE))
    many, competitors = numbers(F.lit(0), F.col("competitors").cast("long"))
    greatest = F.array_max(linked)
    out = [
        row(claims, facts.CLAIM, claim, F.col("value"), more, number + facts.TEXT * text),
        row(t["authorities"], facts.AUTHORITY, id=F.col("id"), more=F.concat(of(F.col("artist_type"), F.col("begin")), some("homepages"))),
        row(t["profiles"], facts.PROFILE, id=F.col("id"), more=F.concat(of(F.when(named != "", named), F.when(key != "", key)), some("aliases"))),
        row(t["retired"], facts.RETIRED, place("provider", facts.PROVIDERS) + bit(F.col("state") == "redirected", 8) + bit(F.col("state") == "deprecated", 16), F.col("id")),
        row(t["catalogs"], facts.CATALOG, bit(F.col("releases") > 0), F.col("id"), F.col("titles")),
        row(t["lookups"].where("id is not null"), facts.LOOKUP, id=F.col("id")), row(t["stored"], facts.STORED, id=F.col("external_id")),
        row(t["audit"], facts.AUDIT, 0, F.array_min(linked), F.when(many, of(greatest, none, F.lit(0), F.col("competitors"))).when(greatest.isNotNull(), of(greatest)), competitors),
        row(t["errors"], facts.ERROR), row(t["blocked"], facts.BLOCKED, id=F.col("code")),
    ]
    if relations is not None:
        other = F.exists("corroborations", lambda x: given(x["source"]) & (x["source"] != F.col("source")) & given(x["evidence_ref"]))
        told = relations.where(F.col("relationship_type").isin(*LEGAL_RELATIONS) & given(F.col("source")) & given(F.col("evidence_ref")) & F.coalesce(other, F.lit(False)))
        out.append(row(told.where("ids is not null"), facts.RELATION, more=F.col("ids")))
    # two catalogs share what their titles say; only of three and more are pairs counted
    shared_folder(t["stored"].sparkSession)
    several = t["catalogs"].select("entity", "id").repartition("entity").distinct().groupBy("entity").agg(F.count("*").alias("n")).where("n > 2").select("entity")
    if not several.isEmpty():
        pairs = shared_titles(t["catalogs"].join(several, "entity", "left_semi"))
        out.append(row(pairs, facts.PAIR, bit(F.col("overlap") >= 2)))
    return out


def entity_facts(t: dict[str, DataFrame], claims: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """A row for each entity with all that its tables say, by which interpret, identity_facts and close_multiplicity decide.

    Tables aren't joined: each row is dealt by its entity once, and a task reads entity after entity (facts.gathered), the
    rows of many at a time. So no step depends on how many tables there are, and all that a task holds are the rows at hand.
    """
    kind = claims.schema["entity"].dataType.simpleString()
    rows = _union(_fact_rows(t, claims, relations)).repartition("entity").sortWithinPartitions("entity")
    columns = [c.split()[0] for c in facts.ROWS.split(", ")]
    return rows.select(*columns).mapInArrow(facts.gathered, facts.FACTS.format(kind))


def _codes(*pairs) -> Column:
    """As reasons, by code that Spark compiles: a filter of an array is interpreted, which took most of the time of a decision."""
    return F.concat(*(F.when(cond, F.array(F.lit(name))).otherwise(F.expr(NONE)) for name, cond in pairs))


def _interpreted(df: DataFrame) -> DataFrame:
    """entity_facts with contradictions, multiplicity_evidence, unresolved, interpretation and qualifies."""
    profiles, authorities, joint = F.col("dg"), F.col("mb"), F.col("joint")
    contradictions = _codes(("different_artist_type", F.col("kinds")), ("different_birth_or_begin_date", F.col("begins") > 1))
    first = _codes(
        ("mutually_linked_discogs_alias_profiles", F.col("mutual")), ("compatible_alias_chronology", F.col("mutual") & F.col("same_begin")), ("musicbrainz_catalog_overlap", joint),
        ("multiple_discogs_profiles_asserted_by_one_musicbrainz_entity", (profiles > 1) & (F.col("most_profiles") >= profiles)),
        ("shared_discogs_real_name", (profiles > 1) & (F.col("dg_records") == profiles) & F.col("one_name")),
    )
    second = _codes(("multiple_musicbrainz_profiles_assert_same_spotify_entity", (authorities > 1) & (F.col("agreeing") == authorities)))
    df = df.withColumns({"contradictions": contradictions, "_first": first}).withColumn("multiplicity_evidence", F.concat("_first", second))
    df = df.withColumn("unresolved", F.concat("lost_ids", _codes(
        ("unexplained_multiple_discogs_ids", (profiles > 1) & (F.size("_first") == 0)),
        ("incompatible_or_unlinked_official_urls", (authorities > 1) & (F.col("with_pages") > 1) & ~F.col("linked_pages") & ~joint),
        ("unexplained_multiple_musicbrainz_ids", (authorities > 1) & (F.size("multiplicity_evidence") == 0)), ("multiple_active_wikidata_qids", F.col("active_others") > 0))))
    clear = F.size("unresolved") == 0
    meaning = (
        F.when(F.size("contradictions") > 0, SEMANTIC).when(clear & F.col("redirected"), REDIRECTED).when(clear & F.col("deprecated"), DEPRECATED)
        .when(clear & (F.size("multiplicity_evidence") > 0), MULTIPLICITY).otherwise(OPEN)
    )
    df = df.withColumn("interpretation", meaning).drop("_first")
    return df.withColumn("qualifies", F.col("interpretation").isin(MULTIPLICITY, REDIRECTED, DEPRECATED) & F.col("anchored"))


def interpret(t: dict[str, DataFrame], claims: DataFrame) -> DataFrame:
    """A row for each entity of claims: what several ids of a provider mean.

    entity, interpretation, contradictions, multiplicity_evidence, unresolved (arrays of codes; unresolved also has
    provider:id), anchored (whether a catalog has releases), qualifies. claims as gather_claims has them, t the tables.
    Precedence: contradiction; then, unless an id is unresolved, redirected, deprecated, multiplicity.
    """
    df = _interpreted(entity_facts(t, claims)).where("mb + dg + wd + sp > 0")
    return df.select("entity", "interpretation", "contradictions", "multiplicity_evidence", "unresolved", "anchored", "qualifies", "mutual")


def identity_facts(t: dict[str, DataFrame], claims: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """What claims, records and audit say of each entity of t['stored']: the facts that its outcome is decided by.

    url_entities, mb, dg, wd (ids of each kind), conflict (a kind with several values), confirmed (an authority links back
    to the stored id), graph_asserts, graph_unique, mb_records, dg_records (ids with a record), audited, competitors,
    foreign_links (an entity of the same name has another stored id), errors, what interpret says, and what
    close_multiplicity needs (with relations, see there).
    """
    df = _interpreted(entity_facts(t, claims, relations)).withColumn("own", F.explode("own")).withColumn("external_id", F.col("own.id")).drop("own")
    df = df.withColumn("graph_unique", (F.col("wd") == 1) & F.col("graph_says")).withColumn("conflict", F.greatest("mb", "dg", "wd", "sp") > 1)
    # an audit needs the one authority that it sets others against
    df = df.withColumn("audited", F.col("audited") & ((F.col("mb") == 1) | (F.col("url_entities") == 1)))
    foreign = F.coalesce((F.col("linked_lo") != F.col("external_id")) | (F.col("linked_hi") != F.col("external_id")), F.lit(False))
    return df.withColumn("foreign_links", foreign & F.col("audited")).withColumn("competitors", F.when(F.col("audited"), F.coalesce("competitors", F.lit(0))))


def optional_profile(facts: DataFrame) -> Column:
    """Whether all else is so clear that no profile is needed."""
    return (
        (F.col("dg") == 0) & F.col("graph_asserts") & F.col("graph_unique") & (F.col("mb") == 1) & (F.col("mb_records") == 1) & F.col("confirmed") & F.col("audited")
        & ~F.col("foreign_links") & ~F.col("conflict") & (F.size("contradictions") == 0) & (F.size("unresolved") == 0) & (F.col("errors") == 0)
    )


def identity_outcome(facts: DataFrame) -> DataFrame:
    """facts (identity_facts) with outcome, the first rule that holds, and missing_evidence, the codes of what isn't there."""
    df = facts.withColumn("optional_profile", optional_profile(facts))
    many = (F.col("mb") > 1) | (F.col("dg") > 1) | (F.col("wd") > 1) | F.col("conflict")
    all_mb = (F.col("mb") > 0) & (F.col("mb_records") == F.col("mb"))
    complete = all_mb & (F.col("dg") > 0) & (F.col("dg_records") == F.col("dg"))
    outcome = (
        F.when(F.col("url_entities") > 1, UNRESOLVED).when(F.col("interpretation") == SEMANTIC, SEMANTIC).when(many & F.col("qualifies"), MULTIPLICITY).when(many, UNRESOLVED)
        .when((F.col("mb") == 0) & (F.col("wd") == 0), UNRESOLVED).when(~F.col("confirmed") | ~(complete | F.col("optional_profile")) | ~F.col("audited"), INSUFFICIENT)
        .when(F.col("competitors") > 0, SAME_NAME).otherwise(COHERENT)
    )
    missing = _codes(
        ("wikidata_qid", F.col("wd") == 0), ("musicbrainz_artist_id", F.col("mb") == 0), ("musicbrainz_spotify_relationship", (F.col("mb") > 0) & ~F.col("confirmed")),
        ("discogs_artist_id", F.col("dg") == 0), ("musicbrainz_exact_record", F.col("mb_records") < F.col("mb")), ("discogs_exact_record", F.col("dg_records") < F.col("dg")),
        ("musicbrainz_same_name_audit", ~F.col("audited")),
    )
    more = F.when(F.col("blocked").isNull(), F.expr(NONE)).otherwise(F.array("blocked"))
    return df.withColumn("outcome", F.when(F.col("blocked").isNotNull(), UNRESOLVED).otherwise(outcome)).withColumn("missing_evidence", F.array_union(missing, more))


def close_multiplicity(facts: DataFrame) -> DataFrame:
    """facts with open_reasons (all that keep several profiles from being one identity), mechanically_closed and explanation.

    facts as identity_facts has them, with relations(entity, relationship_type, ids array, source, evidence_ref,
    corroborations array of struct<source, evidence_ref>): a relation of legal names that covers just the claimed profiles
    and that another source than its own confirms stands for an equal legal name.
    """
    df = facts
    several = F.col("dg") > 1
    explained = F.col("shared_name") | F.col("corroborated")
    head = _codes(
        ("not_provider_profile_multiplicity", F.col("interpretation") != MULTIPLICITY), ("semantic_contradiction_present", F.size("contradictions") > 0),
        ("unresolved_identifier_present", F.size("unresolved") > 0), ("provider_error_present", F.col("errors") > 0),
        ("stored_spotify_not_confirmed_by_musicbrainz", ~F.col("confirmed")), ("no_positive_catalog_anchor", ~F.col("anchored")),
        ("same_name_ambiguity_present_or_not_evaluated", ~F.col("audited") | (F.col("competitors") > 0)), ("wikidata_identifier_not_unique", F.col("wd") != 1),
        ("musicbrainz_identifier_not_unique", F.col("mb") != 1), ("unresolved_alternate_spotify_identifier", F.col("sp") != 1),
    )
    tail = _codes(
        ("discogs_alternates_not_mutually_linked", several & ~F.col("linked")), ("discogs_alternates_have_missing_legal_name", several & ~F.col("every_name") & ~F.col("corroborated")),
        ("discogs_alternates_lack_shared_legal_name", several & F.col("every_name") & ~explained), ("discogs_alternates_lack_corroborated_legal_name_relationship", several & ~explained),
    )
    df = df.withColumn("open_reasons", F.concat(head, "lost_records", tail))
    why = F.when(several & F.col("linked") & F.col("shared_name"), "mutual_alias_and_shared_nonempty_legal_name").when(several & F.col("linked") & F.col("corroborated"),
        "mutual_alias_and_independently_corroborated_legal_name_relationship")
    return df.withColumn("mechanically_closed", F.size("open_reasons") == 0).withColumn("explanation", why)


def route_outcome(df: DataFrame) -> DataFrame:
    """df(outcome, mechanically_closed) with next_state and reason_code; both null for an outcome that isn't known."""
    from .lifecycle import CLOSED_REASON, ROUTE_REASONS, ROUTES

    table = lambda values: F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), F.col("outcome"))
    closed = (F.col("outcome") == MULTIPLICITY) & F.coalesce("mechanically_closed", F.lit(False))
    return df.withColumn("next_state", F.when(closed, "identity_coherent").otherwise(table(ROUTES))).withColumn("reason_code", F.when(closed, CLOSED_REASON).otherwise(table(ROUTE_REASONS)))


def resolve_identities(t: dict[str, DataFrame], relations: DataFrame) -> DataFrame:
    """From raw tables to outcome, what is missing, what keeps profiles open, and the next state of each stored entity."""
    claims = gather_claims(t["stored"], t["claims"], t["authorities"], t["profiles"], t["lookups"])
    return route_outcome(close_multiplicity(identity_outcome(identity_facts(t, claims, relations))))


def review_multiplicity(reports: DataFrame, catalogs: DataFrame, authorities: DataFrame, profiles: DataFrame) -> DataFrame:
    """(entity, qualifies, review_reasons): a stored report of several profiles, judged strictly.

    reports: entity, review_only, interpretation, contradictions, unresolved, multiplicity_evidence (arrays), provenance
    (claims that it has), unsafe (whether it changed anything). catalogs: entity, provider, id, titles, releases,
    earliest_year. authorities: entity, name, artist_type, begin. profiles: entity, name, real_name.
    """
    size = catalogs.groupBy("entity").agg(*(F.count_if(F.expr(x)).alias(c) for x, c in (("releases > 0", "full"), ("provider = 'spotify'", "own"), ("provider = 'spotify' and releases > 0", "own_full"))))
    # catalogs of the stored provider that share no title: pairs of dated ones, less those with an overlap
    dated = catalogs.where("provider = 'spotify' and earliest_year is not null")
    pairs = dated.groupBy("entity").agg(F.countDistinct("id").alias("n"))
    sharing = shared_titles(dated.select("entity", "id", "titles")).groupBy("entity").agg(F.count("*").alias("sharing"))
    apart = pairs.join(sharing, "entity", "left").select("entity", (F.col("n") * (F.col("n") - 1) / 2 > F.coalesce("sharing", F.lit(0))).alias("apart"))
    kinds = authorities.where("name <> ''").groupBy("entity").agg(F.countDistinct(F.when(F.col("artist_type") != "", F.col("artist_type"))).alias("kinds"), F.countDistinct(F.when(F.col("begin") != "", F.col("begin"))).alias("begins"))
    names = profiles.where("name <> ''").groupBy("entity").agg(F.count("*").alias("named"), F.countDistinct(F.when(F.col("real_name") != "", F.col("real_name"))).alias("real_names"))
    df = reports
    for part in (size, apart, kinds, names):
        df = df.join(part, "entity", "left")
    df = df.fillna(0, ["full", "own", "own_full", "kinds", "begins", "named", "real_names"])
    has = lambda code: F.array_contains("multiplicity_evidence", code)
    out = reasons(
        ("not_review_only", ~F.coalesce("review_only", F.lit(False))), ("not_multiplicity_interpretation", ~F.coalesce(F.col("interpretation") == MULTIPLICITY, F.lit(False))),
        ("semantic_contradiction_present", F.size("contradictions") > 0), ("unresolved_identifier_present", F.size("unresolved") > 0),
        ("no_positive_multiplicity_evidence", F.size("multiplicity_evidence") == 0), ("missing_provenance", F.coalesce("provenance", F.lit(0)) == 0),
        ("unsafe_side_effect_flag", F.coalesce("unsafe", F.lit(True))), ("no_positive_catalog_anchor", F.col("full") == 0),
        ("incompatible_active_catalogs", (F.col("own_full") > 1) & F.coalesce("apart", F.lit(False))), ("incompatible_artist_types", F.col("kinds") > 1),
        ("incompatible_chronology", (F.col("begins") > 1) & ~has("compatible_alias_chronology")),
        ("uncorroborated_discogs_multiplicity", (F.col("named") > 1) & ~has("mutually_linked_discogs_alias_profiles") & (F.col("real_names") != 1)),
        ("empty_catalogs_cannot_establish_identity", (F.col("own") > 1) & (F.col("own_full") == 0)),
    )
    return df.select("entity", (F.size(out) == 0).alias("qualifies"), out.alias("review_reasons"))


def batch_outcome(agreement: DataFrame, bridges: DataFrame, records: DataFrame, audit: DataFrame, errors: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """(entity, outcome, missing_evidence) of each entity of agreement(entity, identifier_type, status).

    bridges: entity, authority_id, profile_id (a row: the entity was found). records: entity, provider (musicbrainz or
    discogs). audit: entity, competitors; without a row the name was never compared. errors: entity, provider.
    required: the types that must agree.
    """
    kind, status = F.col("identifier_type"), F.col("status")
    state = agreement.groupBy("entity").agg(F.max(status == "conflict").alias("conflict"), F.countDistinct(F.when((status == "agreement") & kind.isin(*required), kind)).alias("agreed"))
    bridge = bridges.groupBy("entity").agg(F.max("authority_id").alias("authority_id"), F.max("profile_id").alias("profile_id"), F.lit(True).alias("bridged"))
    got = records.groupBy("entity").agg(*(F.max(F.col("provider") == p).alias(c) for p, c in (("musicbrainz", "authority"), ("discogs", "profile"))))
    names = audit.groupBy("entity").agg(F.max(F.coalesce("competitors", F.lit(0))).alias("competitors"))
    failed = errors.groupBy("entity").agg(F.lit(True).alias("failed"))
    df = state
    for part in (bridge, got, names, failed):
        df = df.join(part, "entity", "left")
    df = df.fillna(False, ["bridged", "authority", "profile", "failed"])
    mb, dg = F.col("authority_id").isNotNull(), F.col("profile_id").isNotNull()
    audited = F.col("competitors").isNotNull() & mb
    outcome = (
        F.when(F.col("failed") | ~F.col("bridged"), UNRESOLVED).when(F.col("conflict"), CONFLICTING)
        .when(~mb | ~dg | ~F.col("authority") | ~F.col("profile") | ~audited | (F.col("agreed") < len(required)), INSUFFICIENT)
        .when(F.col("competitors") > 0, SAME_NAME).otherwise(COHERENT)
    )
    missing = reasons(
        ("wikidata_bridge", ~F.col("bridged")), ("wikidata_musicbrainz_id", F.col("bridged") & ~mb), ("wikidata_discogs_id", F.col("bridged") & ~dg),
        ("musicbrainz_record", mb & ~F.col("authority")), ("discogs_record", dg & ~F.col("profile")), ("musicbrainz_same_name_audit", F.col("authority") & ~audited),
    )
    return df.select("entity", outcome.alias("outcome"), missing.alias("missing_evidence"))
