"""Documents and their versions: status, duplicates, activation, current and latest editions, refresh decisions, aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docustrata.functions.codes import alias_form, code_aliases, compact_title, family, year
from docustrata.functions.dates import is_newer
from docustrata.functions.text import content_hash, squeeze
from docustrata.operators.relational import top, with_previous
from docustrata.operators.skew import hot_keys, replicated, salted

#: Parameters: the status vocabularies of a registry.
ACTIVE = ["имеет силу", "имеет силу с изменениями", "имеет силу частично"]
INACTIVE = ["не имеет силы", "сила прекращена", "снят с применения", "замещён новым изданием"]


def classify_status(c: Column, active: list[str] = ACTIVE, inactive: list[str] = INACTIVE) -> Column:
    """active, inactive or unknown by the vocabularies."""
    low = F.lower(squeeze(c))
    return F.when(low.isin(*active), "active").when(low.isin(*inactive), "inactive").otherwise("unknown")


def resolve_status(card: Column, listed: Column) -> list[Column]:
    """status of the card's word, of the list's where the card has none; conflict where both speak and differ."""
    c, l = squeeze(card), squeeze(listed)  # noqa: E741
    conflict = F.coalesce((c != "") & (l != "") & (F.lower(c) != F.lower(l)), F.lit(False))
    return [classify_status(F.coalesce(F.nullif(c, F.lit("")), l)).alias("status"), conflict.alias("conflict")]


def duplicates(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, content_hash, active_id (the least key of equal contents), is_duplicate. Null texts hash like empty ones."""
    hashed = texts.select(F.col(key), content_hash(F.col(text)).alias("content_hash"))
    first = hashed.groupBy("content_hash").agg(F.min(key).alias("active_id"))
    return hashed.join(first, "content_hash").select(key, "content_hash", "active_id", (F.col(key) != F.col("active_id")).alias("is_duplicate"))


def duplicate_groups(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Contents that occur more than once: content_hash, n, keep_id."""
    return texts.select(F.col(key), content_hash(F.col(text)).alias("content_hash")).groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("keep_id")).where("n > 1")


def activations(versions: DataFrame) -> DataFrame:
    """Events of versions (document_id, version_id, content_hash, created_at) taken in order: version_id, event, reason, is_active.

    A version whose hash equals that of the version active before it is skipped; any other is activated and retires the one before.
    As a skipped version doesn't change the active hash, that hash is the one of the row before. A document with very many versions is
    split: its rows lie over several parts, and what is gathered of it is one row. Rows without a document are left out.
    """
    keyed = versions.where("document_id is not null").select("document_id", "version_id", "content_hash", "created_at")
    marked = with_previous(keyed, ["document_id"], ["created_at", "version_id"], ["content_hash"], "_row")
    marked = marked.withColumns({"_before": F.col("_row.content_hash"), "_first": F.col("_row").isNull()})
    skipped = F.col("_before").eqNullSafe(F.col("content_hash")) & ~F.col("_first")
    seen = marked.withColumns({"event": F.when(skipped, "skipped_duplicate").otherwise("activated"), "reason": F.when(F.col("_first"), "initial_activation").when(skipped, "equal_content_hash").otherwise("new_content_hash")})
    last = seen.groupBy("document_id").agg(F.max_by("version_id", F.when(F.col("event") == "activated", F.struct("created_at", "version_id"))).alias("_last"))
    hot = hot_keys(keyed, ["document_id"])
    joined = salted(seen, hot, ["document_id"], "version_id").join(replicated(last, hot, ["document_id"]), ["document_id", "_salt"])
    return joined.select("document_id", "version_id", "event", "reason", (F.col("version_id") == F.col("_last")).alias("is_active"))


def current_documents(registry: DataFrame) -> DataFrame:
    """One row per document: that registered last (ties by code); of deleted rows none."""
    live = registry.where("deleted_at is null and document_id is not null")
    columns = ["normalized_code", "display_code", "document_type", "title", "status_normalized", "current_version_id", "created_at"]
    picked = live.groupBy("document_id").agg(F.max(F.struct("created_at", *[c for c in columns if c != "created_at"])).alias("v"))
    return picked.select("document_id", *[F.col(f"v.{c}").alias(c) for c in columns])


def active_versions(documents: DataFrame, versions: DataFrame, strict: bool = False) -> DataFrame:
    """The current version of each document, else the newest active one (versions: document_id, version_id, is_active, created_at).

    ``strict``: a document with several active versions fails the query.
    """
    picked = F.max_by("version_id", F.struct("created_at", "version_id"))
    if strict:
        picked = F.when(F.count_distinct("version_id") > 1, F.raise_error(F.concat(F.lit("several active versions of "), F.max("document_id"))).cast("string")).otherwise(picked)
    newest = versions.where("is_active").groupBy("document_id").agg(picked.alias("_newest"))
    return documents.join(newest, "document_id", "left").select("document_id", F.coalesce("current_version_id", "_newest").alias("version_id"))


def latest_editions(documents: DataFrame) -> DataFrame:
    """Per family the newest edition: family, latest_year, document_id (the least on a tie). Codes without a year have no edition."""
    dated = documents.select("document_id", family(F.col("display_code")).alias("family"), year(F.col("display_code")).alias("edition")).where("edition is not null")
    return dated.groupBy("family").agg(F.max("edition").alias("latest_year"), F.min_by("document_id", F.struct(-F.col("edition"), "document_id")).alias("document_id"))


def refresh_decisions(cards: DataFrame, documents: DataFrame) -> DataFrame:
    """Whether a card asks for a refresh of its document: card_id, needs_refresh, reasons (status_changed, newer_source).

    documents: document_id, status_normalized, text_actualized_at. No local date is older than any; no source date is never newer.
    """
    local = documents.select("document_id", F.col("status_normalized").alias("_status"), F.col("text_actualized_at").alias("_date"))
    joined = cards.join(local, "document_id")
    changed = F.coalesce(classify_status(F.col("card_status_raw")) != F.lower(F.trim("_status")), F.lit(False))
    newer = is_newer(F.col("text_actualized_at"), F.col("_date"))
    reasons = F.array_compact(F.array(F.when(changed, "status_changed"), F.when(newer, "newer_source")))
    return joined.select("card_id", (F.size(reasons) > 0).alias("needs_refresh"), F.array_join(reasons, ",").alias("reasons"))


def accepted_cards(cards: DataFrame, documents: DataFrame) -> DataFrame:
    """What becomes of the cards: card_id, action (skip_inactive, skip_unknown, update, insert). Only the last card of a document counts."""
    last = top(cards.where("document_id is not null"), ["document_id"], [F.desc_nulls_last("seen_at"), F.desc("card_id")], 1)
    status = classify_status(F.coalesce(F.nullif(squeeze(F.col("card_status_raw")), F.lit("")), F.col("source_list_status_raw")))
    joined = last.join(documents.select("document_id", F.lit(True).alias("_known")), "document_id", "left")
    action = F.when(status == "inactive", "skip_inactive").when(status == "unknown", "skip_unknown").when(F.col("_known"), "update").otherwise("insert")
    return joined.select("card_id", "document_id", action.alias("action"))


def built_aliases(documents: DataFrame, urls: DataFrame | None = None) -> DataFrame:
    """Aliases of documents (document_id, display_code, normalized_code, title): document_id, alias_normalized, alias_raw, alias_type, confidence.

    Derived from the codes, the title, its first sentence and URLs (document_id, url); longer ones than 255 characters are dropped;
    of equal normalized aliases of a document the most confident is kept, then the least type and spelling.
    """
    made = [
        documents.select("document_id", F.explode(code_aliases(F.col("display_code"))).alias("alias_raw"), F.lit("display_code").alias("alias_type"), F.lit(1.0).alias("confidence")),
        documents.select("document_id", F.explode(code_aliases(F.col("normalized_code"))).alias("alias_raw"), F.lit("normalized_code").alias("alias_type"), F.lit(1.0).alias("confidence")),
        documents.select("document_id", squeeze(F.col("title")).alias("alias_raw"), F.lit("title").alias("alias_type"), F.lit(0.9).alias("confidence")),
        documents.select("document_id", compact_title(F.col("title")).alias("alias_raw"), F.lit("short_title").alias("alias_type"), F.lit(0.8).alias("confidence")),
    ]
    if urls is not None:
        made.append(urls.select("document_id", F.col("url").alias("alias_raw"), F.lit("url").alias("alias_type"), F.lit(0.7).alias("confidence")))
    rows = made[0]
    for more in made[1:]:
        rows = rows.unionByName(more)
    formed = rows.withColumn("alias_normalized", alias_form(F.col("alias_raw"))).where("alias_normalized is not null and length(alias_normalized) <= 255")
    best = formed.groupBy("document_id", "alias_normalized").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "alias_type", "alias_raw")).alias("b"))
    return best.select("document_id", "alias_normalized", F.col("b.alias_raw").alias("alias_raw"), F.col("b.alias_type").alias("alias_type"), (-F.col("b.c")).alias("confidence"))


def best_aliases(aliases: DataFrame) -> DataFrame:
    """Per document and normalized alias the most confident row, then the least type and id; null confidence counts as nought."""
    order = [F.desc(F.coalesce("confidence", F.lit(0.0))), F.asc_nulls_last("alias_type"), F.asc("alias_id")]
    return top(aliases.where("document_id is not null and alias_normalized is not null"), ["document_id", "alias_normalized"], order, 1).drop("rk")


def aliases_with_prefix(prefixes: DataFrame, aliases: DataFrame, k: int = 25) -> DataFrame:
    """The k most confident aliases that start with a prefix (prefix): prefix, alias_normalized, document_id, rk.

    A prefix is matched as it is, without wildcards: aliases spread their starts of the prefixes' lengths and join by equality.
    """
    lengths = [r[0] for r in prefixes.where("length(prefix) <= 255").select(F.length("prefix")).distinct().collect()]
    spread = aliases.withColumn("prefix", F.explode(F.array_distinct(F.array(*[F.substring("alias_normalized", 1, n) for n in lengths] or [F.lit("")]))))
    joined = prefixes.distinct().join(spread, "prefix")
    return top(joined, ["prefix"], [F.desc(F.coalesce("confidence", F.lit(0.0))), F.asc("alias_normalized"), F.asc("document_id")], k).select("prefix", "alias_normalized", "document_id", "rk")
