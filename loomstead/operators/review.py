"""Review of tags, links and runs: filters, rankings, comparisons and accounts on tables of judgments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.functions.numeric import haversine_km, share
from loomstead.operators.graph import connected
from loomstead.operators.sets import first_by_rank


def without_pairs(stories: DataFrame, pairs: DataFrame, story: str, tags: str, tag: str) -> DataFrame:
    """``stories`` with arrays ``tags`` that lack the tags a pair names; pairs meet their story once, as an array."""
    drop = pairs.groupBy(story).agg(F.collect_set(tag).alias("_drop"))
    return stories.join(drop, story, "left").withColumn(tags, F.array_except(F.coalesce(tags, F.array().cast("array<string>")), F.coalesce("_drop", F.array().cast("array<string>")))).drop("_drop")


def overridden(base: DataFrame, override: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``value`` of ``override`` where it has one, else that of ``base``."""
    o = override.select(*keys, F.col(value).alias("_o")).where("_o is not null").dropDuplicates(keys)
    return base.join(o, keys, "left").withColumn(value, F.coalesce("_o", value)).drop("_o")


def only_groups_with(rows: DataFrame, group: str, holds: Column) -> DataFrame:
    """Rows of the groups in which some row holds."""
    return rows.join(rows.where(holds).select(group).distinct(), group, "left_semi")


def at_current_hash(verdicts: DataFrame, current: DataFrame, tag: str, prompt_hash: str) -> DataFrame:
    """Verdicts given under the prompt that their tag has now; ``current`` has both columns."""
    return verdicts.join(current.select(tag, prompt_hash).distinct(), [tag, prompt_hash], "left_semi")


def eligible_prefixes(items: DataFrame, tag: str, least: int = 3) -> DataFrame:
    """Categories of which some sub-topic occurs often enough."""
    often = items.where(F.col(tag).contains(":")).groupBy(tag).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return often.select(F.substring_index(tag, ":", 1).alias("category")).distinct()


def composition(items: DataFrame, topic: str, item: str, tier: str, tiers: list[str], strong: list[str], least: int, ends: int) -> DataFrame:
    """Distinct items per topic and tier with the share of the strong tiers; the topics of the ``ends`` lowest and highest shares."""
    n = lambda v: F.countDistinct(F.when(F.col(tier).isin(*v), F.col(item)))
    t = items.groupBy(topic).agg(*[n([x]).alias(f"n_{x}") for x in tiers], n(tiers).alias("total"), n(strong).alias("strong")).where(F.col("total") >= least)
    t = t.select("*", F.round(F.col("strong") / F.col("total"), 6).alias("share")).drop("strong")
    return t.orderBy("share", topic).limit(ends).union(t.orderBy(F.col("share").desc(), F.col(topic).desc()).limit(ends)).distinct()


def two_groups(items: DataFrame, flag: Column, tier: str, item: str) -> DataFrame:
    """Share of each tier among the flagged and among the other items."""
    c = items.groupBy(flag.alias("flagged"), F.col(tier).alias("tier")).agg(F.countDistinct(item).alias("n"))
    return c.withColumn("pct", share(F.col("n"), F.sum("n").over(Window.partitionBy("flagged"))))


def grouped_occurrences(sources: list[DataFrame], text: str, kind: str, key: Column) -> DataFrame:
    """Per normalized text and kind over all sources: occurrences and the longest typing, the first of equal ones."""
    every = sources[0].select(text, kind)
    for s in sources[1:]:
        every = every.unionByName(s.select(text, kind))
    return every.where(key != "").groupBy(key.alias("norm"), kind).agg(F.count("*").alias("n"), F.max_by(text, F.struct(F.length(text), text)).alias("display"))


def run_comparison(old: DataFrame, new: DataFrame, keys: list[str], category: Column) -> DataFrame:
    """Per category of two runs ``(keys, applies)``: judged and true ones of each, those that flipped, and the change in points."""
    j = old.select(*keys, F.col("applies").alias("old")).join(new.select(*keys, F.col("applies").alias("new")), keys, "full")
    c = lambda x: F.count_if(F.coalesce(x, F.lit(False)))
    out = j.groupBy(category.alias("category")).agg(F.count("old").alias("old_n"), c(F.col("old")).alias("old_true"), F.count("new").alias("new_n"), c(F.col("new")).alias("new_true"), c(F.col("old") != F.col("new")).alias("flips"))
    return out.withColumn("change", F.round(F.try_divide(100.0 * F.col("new_true"), F.col("new_n")) - F.try_divide(100.0 * F.col("old_true"), F.col("old_n")), 4))


def worst(judged: DataFrame, tag: str, applies: str, least: int = 3, top: int = 20) -> DataFrame:
    """Sub-tags of the most rejections, with the share rejected."""
    c = judged.where(F.col(applies).isNotNull()).groupBy(tag).agg(F.count_if(~F.col(applies)).alias("rejected"), F.count("*").alias("judged")).where(F.col("rejected") >= least)
    return c.withColumn("pct", share(F.col("rejected"), F.col("judged"))).orderBy(F.col("rejected").desc(), tag).limit(top)


def account(changes: DataFrame, edition: str, category: str) -> DataFrame:
    """Insertions and removals per edition and category, with the net change; ``changes`` has ``action``."""
    c = lambda a: F.count_if(F.col("action") == a)
    return changes.groupBy(edition, category).agg(c("insert").alias("inserted"), c("remove").alias("removed"), (c("insert") - c("remove")).alias("net"))


def max_pooled(chunks: DataFrame, item: str, offset: str, sim: str) -> DataFrame:
    """An item's likest chunk: its similarity and offset, the earliest of equal ones."""
    return chunks.groupBy(item).agg(F.max(sim).alias(sim), F.max_by(offset, F.struct(F.col(sim), -F.col(offset))).alias(offset))


def renamed_tags(stories: DataFrame, rules: DataFrame, story: str, tags: str) -> DataFrame:
    """Tag arrays under ``rules (tag, action, targets)``: ``drop`` takes a tag out, ``split`` and ``rename`` put others in its
    place; order is kept and each tag stands once. Rules are joined by tag, so a list of any length does."""
    each = stories.select(story, F.posexplode(tags).alias("pos", "tag")).join(rules.dropDuplicates(["tag"]), "tag", "left")
    to = F.when(F.col("action") == "drop", F.array().cast("array<string>")).when(F.col("action").isNotNull(), F.col("targets")).otherwise(F.array("tag"))
    back = each.groupBy(story).agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", to.alias("to")))), lambda x: x["to"]))).alias(tags))
    return stories.drop(tags).join(back, story, "left").withColumn(tags, F.coalesce(tags, F.array().cast("array<string>")))


def merged_rules(base: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Rules ``(old, new)`` of both, those of the taxonomy before the others."""
    ranked = base.withColumn("_s", F.lit(1)).unionByName(taxonomy.withColumn("_s", F.lit(0)))
    return first_by_rank(ranked, ["old"], F.col("_s"), F.col("new")).drop("_s")


def first_of_sources(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of the sources with their number, each key once, from the first that has it."""
    every = None
    for i, s in enumerate(sources):
        one = s.withColumn("source_no", F.lit(i + 1))
        every = one if every is None else every.unionByName(one)
    rest = [c for c in every.columns if c not in keys]
    return every.groupBy(*keys).agg(F.min(F.struct("source_no", *[c for c in rest if c != "source_no"])).alias("_f")).select(*keys, "_f.*")


def applied_links(mentions: DataFrame, per_mention: DataFrame, by_name: DataFrame, name: str, bare: Column) -> DataFrame:
    """What links do to ``mentions (mention_id, name, ref)``: a link for the mention goes before one for its name, that before
    one for the name without an attached letter. ``noop`` where the ref is there already, ``conflict`` where another one
    is, which is never overwritten, ``write`` else, ``none`` without a link."""
    names = by_name.select(F.col("name").alias("_n"), F.col("target").alias("_t")).dropDuplicates(["_n"])
    j = mentions.withColumn("_bare", bare).join(per_mention.select("mention_id", F.col("target").alias("_m")), "mention_id", "left")
    j = j.join(names.withColumnsRenamed({"_n": name, "_t": "_whole"}), name, "left").join(names.withColumnsRenamed({"_n": "_bare", "_t": "_part"}), "_bare", "left")
    target = F.coalesce("_m", "_whole", "_part")
    action = F.when(target.isNull(), "none").when(F.col("ref").isNull(), "write").when(F.col("ref") == target, "noop").otherwise("conflict")
    return j.select("mention_id", name, "ref", target.alias("target"), action.alias("action"))


def resolved_mentions(mentions: DataFrame, variants: DataFrame, text: str, ref: str) -> DataFrame:
    """``key`` of each mention: the ref it has, else the entity of a variant, else its own text marked as of editions only."""
    v = variants.select(F.col("variant").alias(text), F.col("entity").alias("_e")).groupBy(text).agg(F.min("_e").alias("_e"))
    return mentions.join(v, text, "left").withColumn("key", F.coalesce(F.col(ref), "_e", F.concat(F.lit("ED::"), F.col(text)))).withColumn("kind", F.when(F.col(ref).isNotNull(), "ref").when(F.col("_e").isNotNull(), "variant").otherwise("edition_only")).drop("_e")


def trusted_siblings(rows: DataFrame, key: str, status: str, confidence: str, candidates: str, least: float) -> DataFrame:
    """Rows whose only candidate a confident row has too: ``auto``, else ``manual``. Two passes, no iteration."""
    one = rows.withColumn("_c", F.when(F.size(candidates) == 1, F.col(candidates)[0]))
    sure = one.where(F.col("_c").isNotNull() & F.col(status).isin("fuzzy", "name_exact") & (F.col(confidence) >= least)).select("_c").distinct().withColumn("_t", F.lit(True))
    return one.join(sure, "_c", "left").select(key, F.col("_c").alias("candidate"), F.when(F.col("_t"), "auto").otherwise("manual").alias("bucket"))


def duplicate_groups(entities: DataFrame, entity: str, values: DataFrame, number: Column, lat: str, lon: str, far_km: float = 50.0) -> DataFrame:
    """``(entity, canonical, members, far)`` of entities that share an identifier, directly or not.

    ``values (entity, kind, value)`` makes edges from an entity to its values, so a value of many holders costs an edge
    each. The canonical one has the lowest number. A group of one is none. ``far`` holds where two members lie more than
    ``far_km`` apart: distances are taken between members of different cells only, and groups are of a few entities."""
    edges = values.where("value is not null and value <> ''").select(F.concat(F.lit("e:"), F.col("entity")).alias("a"), F.concat(F.lit("v:"), "kind", F.lit(":"), "value").alias("b"))
    comp = connected(edges, "a", "b").where("node like 'e:%'").select(F.substring("node", F.lit(3), F.length("node")).alias(entity), "component")
    held = entities.join(comp, entity)
    size = held.groupBy("component").agg(F.count("*").alias("members"), F.min_by(entity, F.struct(number, F.col(entity))).alias("canonical")).where("members > 1")
    kept = held.join(size, "component")
    spot = kept.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select("component", F.col(lat).alias("y"), F.col(lon).alias("x")).distinct()
    pairs = spot.join(spot.withColumnsRenamed({"y": "y2", "x": "x2"}), "component").where("y < y2 or (y = y2 and x < x2)")
    far = pairs.groupBy("component").agg(F.max(haversine_km(F.col("y"), F.col("x"), F.col("y2"), F.col("x2"))).alias("km"))
    return kept.join(far, "component", "left").select(entity, "canonical", "members", F.coalesce(F.col("km") > far_km, F.lit(False)).alias("far"))


def merged_groups(groups: DataFrame, entities: DataFrame, entity: str, names: str, skip: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Groups not flagged as far, nor named in ``skip (canonical)``, as one entity each: all names in order of the members, each
    once; and the map ``(old, new)`` by which references are rewritten."""
    use = groups.where(~F.col("far"))
    if skip is not None:
        use = use.join(skip, "canonical", "left_anti")
    each = use.join(entities.select(entity, F.posexplode_outer(names).alias("pos", "name")), entity)
    first = F.when(F.col(entity) == F.col("canonical"), 0).otherwise(1)
    merged = each.where("name is not null").groupBy("canonical").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(first.alias("o"), F.col(entity).alias("e"), F.col("pos"), F.col("name")))), lambda s: s["name"])).alias(names))
    return merged, use.where(F.col(entity) != F.col("canonical")).select(F.col(entity).alias("old"), F.col("canonical").alias("new"))


def rewritten_refs(rows: DataFrame, ref: str, moves: DataFrame) -> DataFrame:
    """``ref`` under a map ``(old, new)``; refs that it does not name stay."""
    return rows.join(moves.select(F.col("old").alias(ref), F.col("new").alias("_to")), ref, "left").withColumn(ref, F.coalesce("_to", ref)).drop("_to")


def reference_labels(rows: DataFrame, known: DataFrame, text: str, label: str, fallback: dict[str, str]) -> DataFrame:
    """``ref`` of the same text and label, else of the label that may stand in its place."""
    k = known.groupBy(F.col(text).alias("_t"), F.col(label).alias("_l")).agg(F.max("ref").alias("_r"))
    other = F.create_map(*[F.lit(x) for kv in fallback.items() for x in kv])
    j = rows.withColumn("_other", F.element_at(other, F.col(label)))
    j = j.join(k.withColumnsRenamed({"_t": text, "_l": label, "_r": "_same"}), [text, label], "left").join(k.withColumnsRenamed({"_t": text, "_l": "_other", "_r": "_else"}), [text, "_other"], "left")
    return j.withColumn("ref", F.coalesce("_same", "_else")).drop("_same", "_else", "_other")


def lexical_hits(texts: DataFrame, key: str, words: str, lexicon: DataFrame) -> DataFrame:
    """``(key, tag, terms, only_homograph)``: the terms of a tag's ``lexicon (tag, term, term_no, homograph)`` that a text's words
    hold, in the lexicon's order. Words are joined by equality, each once a text."""
    hit = texts.select(key, F.explode(F.array_distinct(words)).alias("term")).join(lexicon, "term")
    return hit.groupBy(key, "tag").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("term_no", "term"))), lambda t: t["term"]), ", ").alias("terms"), F.bool_and("homograph").alias("only_homograph"))


def work_left(targets: DataFrame, verdicts: DataFrame, keys: list[str], category: Column) -> DataFrame:
    """Calls still to make per category: targets without a verdict."""
    return targets.join(verdicts.select(*keys).distinct(), keys, "left_anti").groupBy(category.alias("category")).agg(F.count("*").alias("calls"))


def status_of(rows: DataFrame, cached: DataFrame, keys: list[str], expected: str, given: str) -> DataFrame:
    """``status`` of each row beside a cached answer: ``pending`` without one, ``match`` or ``mismatch``."""
    c = cached.select(*keys, given).dropDuplicates(keys)
    return rows.join(c, keys, "left").withColumn("status", F.when(F.col(given).isNull(), "pending").when(F.col(given) == F.col(expected), "match").otherwise("mismatch"))


def stacked_pairs(centroids: DataFrame, key: str, vector: str) -> DataFrame:
    """``(a, b, sim)`` of all pairs of a few unit vectors, such as the centres of a taxonomy: their number is checked."""
    if centroids.limit(5_001).count() > 5_000:
        raise ValueError("more than 5,000 vectors: use cosine_pairs")
    a, b = (centroids.select(F.col(key).alias(s), F.col(vector).alias(f"v{s}")) for s in ("a", "b"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x).alias("sim"))
