"""Rule catalogs as rows, their checks, and matching of fields against them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.sources.shared import written

from . import structure


@dataclass
class Catalog:
    """types: name -> steps (kind, literal or capture name, class, length); rules, sequences: rows."""

    types: dict[str, list[tuple]]
    rules: list[tuple] = field(default_factory=list)
    sequences: list[tuple] = field(default_factory=list)


RULE = "message_type string, rule_ord int, path string, tag string, options array<string>, qualifier string, name string, field_type string, option_types map<string,string>, required boolean, min int, max int, entity string, column string, render_option string"
SEQUENCE = "message_type string, name string, parents array<string>, repeat boolean, min int, max int"
TYPE = "name string, step int, kind string, word string, class string, length int"

_QUALIFIED = [("literal", ":", None, None), ("capture", "qualifier", "alpha_num", 4), ("literal", "//", None, None)]
TYPES = {
    "reference": [*_QUALIFIED, ("rest", "value", "text", None)],
    "date": [*_QUALIFIED, ("capture", "date", "digits", 8)],
    "amount": [*_QUALIFIED, ("rest", "amount", "text", None)],
    "quantity": [*_QUALIFIED, ("rest", "quantity", "text", None)],
    "code": [*_QUALIFIED, ("rest", "code", "text", None)],
    "text": [("rest", "value", "text", None)],
}


def _rule(mt, n, path, tag, options, qual, name, kind, entity, column, required=False, low=None, high=None, option=None, option_types=None):
    return (mt, n, path, tag, options, qual, name, kind, option_types, required, low, high, entity, column, option)


# Names of entities and columns, tags and qualifiers of the formats.
#: The message types that the queries use.
CATALOG = Catalog(
    TYPES,
    [
        _rule("MT537", 1, "GENL", "20", ["C"], "SEME", "sender reference", "reference", "mt537_statement", "sender_reference", True, option="C"),
        _rule("MT537", 2, "GENL", "98", ["A"], "STAT", "statement date", "date", "mt537_statement", "statement_date", option="A"),
        _rule("MT537", 3, "GENL", "97", ["A"], "SAFE", "account", "reference", "mt537_account", "account", option="A"),
        _rule("MT537", 4, "STAT", "25", ["D"], "IPRC", "status", "code", "mt537_status", "status_code", True, option="D"),
        _rule("MT537", 5, "STAT/TRAN/LINK", "20", ["C"], "RELA", "link", "reference", "mt537_transaction_link", "linked_reference", option="C"),
        _rule("MT537", 6, "STAT/TRAN/TRANSDET", "35B", None, None, "instrument", "text", "mt537_instrument", "instrument", True),
        _rule("MT537", 7, "STAT/TRAN/TRANSDET", "36", ["B"], "SETT", "quantity", "quantity", "settlement_quantity", "quantity", option="B"),
        _rule("MT537", 8, "STAT/TRAN/TRANSDET", "19", ["A"], "PSTA", "posting amount", "amount", "mt537_transaction", "amount", option="A"),
        _rule("MT537", 9, "STAT/TRAN/TRANSDET", "98", ["A", "C"], "SETT", "settlement date", "date", "mt537_transaction", "date", option="A", option_types={"C": "text"}),
        _rule("MT537", 10, "STAT/TRAN/TRANSDET/SETPRTY", "95", ["P"], "DEAG|REAG", "party", "reference", "settlement_party", "party", option="P"),
        _rule("MT537", 11, "STAT/TRAN/TRANSDET/SETPRTY", "97", ["A"], "SAFE", "party account", "reference", "mt537_settlement_party", "account", option="A"),
        _rule("MT540", 1, "GENL", "20", ["C"], "SEME", "sender reference", "reference", "settlement_instruction", "sender_reference", True, 1, 1, option="C"),
        _rule("MT540", 2, "TRADDET", "98", ["A"], "SETT", "settlement date", "date", "settlement_instruction", "settlement_date", option="A"),
        _rule("MT540", 3, "TRADDET", "35B", None, None, "instrument", "text", "settlement_instrument", "instrument", True, 1, 1),
        _rule("MT540", 4, "FIAC", "36", ["B"], "SETT", "quantity", "quantity", "settlement_quantity", "quantity", True, option="B"),
        _rule("MT540", 5, "FIAC", "97", ["A"], "SAFE", "account", "reference", "settlement_account", "account", option="A"),
        _rule("MT540", 6, "SETDET/SETPRTY", "95", ["P"], "DEAG", "party", "reference", "settlement_party", "party", option="P"),
        _rule("MT540", 7, "SETDET/AMT", "19", ["A"], "SETT", "amount", "amount", "settlement_amount", "amount", option="A"),
        _rule("MT536", 1, "GENL", "20", ["C"], "SEME", "sender reference", "reference", "mt536_statement", "sender_reference", True, option="C"),
        _rule("MT536", 2, "GENL", "97", ["A"], "SAFE", "account", "reference", "mt536_account", "account", option="A"),
        _rule("MT536", 3, "TRADDET", "35B", None, None, "instrument", "text", "mt536_instrument", "instrument", True),
        _rule("MT536", 4, "TRADDET", "36", ["B"], "PSTA", "quantity", "quantity", "settlement_quantity", "quantity", option="B"),
        _rule("MT536", 5, "TRADDET", "98", ["A"], "SETT", "settlement date", "date", "mt536_transaction", "date", option="A"),
        _rule("MT536", 6, "SETDET/AMT", "19", ["A"], "SETT", "amount", "amount", "mt536_transaction", "amount", option="A"),
    ],
    [
        ("MT537", "GENL", ["$"], False, 1, 1), ("MT537", "STAT", ["$"], True, 1, None), ("MT537", "TRAN", ["STAT"], True, None, None), ("MT537", "LINK", ["TRAN"], True, None, None), ("MT537", "TRANSDET", ["TRAN"], False, None, None), ("MT537", "SETPRTY", ["TRANSDET"], True, None, None),
        ("MT540", "GENL", ["$"], False, 1, 1), ("MT540", "TRADDET", ["$"], False, 1, 1), ("MT540", "FIAC", ["$"], True, 1, None), ("MT540", "SETDET", ["$"], False, 1, 1), ("MT540", "SETPRTY", ["SETDET"], True, None, None), ("MT540", "AMT", ["SETDET"], True, None, None),
        ("MT536", "GENL", ["$"], False, 1, 1), ("MT536", "TRADDET", ["$"], True, None, None), ("MT536", "SETDET", ["$"], True, None, None), ("MT536", "AMT", ["SETDET"], True, None, None),
    ],
)


def rules(spark: SparkSession, catalog: Catalog = CATALOG) -> DataFrame:
    return spark.createDataFrame(catalog.rules, RULE)


def sequences(spark: SparkSession, catalog: Catalog = CATALOG) -> DataFrame:
    return spark.createDataFrame(catalog.sequences, SEQUENCE)


def types(spark: SparkSession, catalog: Catalog = CATALOG) -> DataFrame:
    return spark.createDataFrame([(name, i, kind, word, cls, n) for name, steps in catalog.types.items() for i, (kind, word, cls, n) in enumerate(steps)], TYPE)


_CLASS = {"alpha_num": "[A-Za-z0-9]", "digits": "[0-9]", "text": "[\\s\\S]"}


def compiled(spark: SparkSession, catalog: Catalog = CATALOG) -> DataFrame:
    """Per field type: the pattern of the whole value, the number of the group whose capture is selected, and the pattern of each
    growing prefix with the failure that it tells."""
    out = []
    for name, steps in catalog.types.items():
        pattern, captures, prefixes = "", [], []
        for kind, word, cls, n in steps:
            if kind == "literal":
                pattern += "".join("\\" + c if not c.isalnum() else c for c in word)
                prefixes.append((f"^{pattern}", "literal_mismatch"))
            elif kind == "capture":
                prefixes.append((f"^{pattern}[\\s\\S]{{{n}}}", "too_short"))
                pattern += f"({_CLASS[cls]}{{{n}}})"
                captures.append(word)
                prefixes.append((f"^{pattern}", "invalid_class"))
            else:
                pattern += "([\\s\\S]*)"
                captures.append(word)
        chosen = next((c for c in ("value", "date", "amount", "quantity", "code") if c in captures), captures[-1] if captures else None)
        out.append((name, f"^{pattern}$", captures.index(chosen) + 1 if chosen else 0, [{"pattern": p, "failure": f} for p, f in prefixes]))
    return spark.createDataFrame(out, "field_type string, pattern string, capture int, prefixes array<struct<pattern:string,failure:string>>")


def expanded(rule_rows: DataFrame) -> DataFrame:
    """A row per concrete tag, qualifier and path of each rule, so that matching is an equality join; a null qualifier fits any.
    Alternatives that a rule repeats count once, so that a field meets a rule once."""
    tags = F.when(F.col("options").isNull(), F.array(F.upper("tag"))).otherwise(F.transform("options", lambda o: F.upper(F.concat(F.col("tag"), o))))
    alternatives = lambda c: F.when(F.col(c).isNull(), F.array(F.lit(None).cast("string"))).otherwise(F.split(c, r"\|"))
    return rule_rows.withColumn("tag_key", F.explode(tags)).withColumn("want", F.explode(alternatives("qualifier"))).withColumn("seq_path", F.explode(F.split("path", r"\|"))).dropDuplicates(["message_type", "rule_ord", "tag_key", "want", "seq_path"])


def matched(field_rows: DataFrame, rule_rows: DataFrame) -> DataFrame:
    """Every rule that each field fits, with the field type that the option letter of its tag asks for. Rules are a catalog, bounded
    reference data, and are broadcast, here and in what follows."""
    r = F.broadcast(expanded(rule_rows).drop("tag", "qualifier"))  # a catalog is bounded reference data
    f = field_rows.withColumn("tag_key", F.upper("tag"))
    joined = f.join(r, ["message_type", "tag_key", "seq_path"]).where(F.col("want").isNull() | (F.col("want") == F.col("qualifier")))
    letter = F.upper(F.substring("tag", -1, 1))
    own = F.try_element_at(F.coalesce("option_types", F.create_map().cast("map<string,string>")), letter)
    return joined.withColumn("field_type", F.coalesce(own, "field_type"))


def normalised(field_type: Column, value: Column) -> Column:
    """Dates as ISO, amounts and quantities as plain decimals, anything else as it is."""
    dates = field_type.contains("date") & ~field_type.contains("datetime")
    amount = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "^N", "-"), r"^(-?)[A-Z]{3}", "$1"), ",", ".")
    quantity = F.regexp_replace(F.substring_index(value, "/", -1), ",", ".")
    return F.when(dates & value.rlike(r"^\d{8}$"), F.regexp_replace(value, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")).when(field_type.contains("amount"), amount).when(field_type.contains("quantity"), quantity).otherwise(value)


def captured(matches: DataFrame, compiled_types: DataFrame) -> DataFrame:
    """matches with raw (the selected capture), normal, and failure (null where the value fits its type)."""
    t = matches.join(F.broadcast(compiled_types), "field_type", "left")
    fits = F.expr("value rlike pattern")
    failure = F.expr("coalesce(element_at(transform(filter(prefixes, p -> not (value rlike p.pattern)), p -> p.failure), 1), 'trailing_input')")
    failure = F.when(F.col("pattern").isNull(), "type_not_found").when(~fits, F.expr("if(size(filter(prefixes, p -> not (value rlike p.pattern))) > 0, filter(prefixes, p -> not (value rlike p.pattern))[0].failure, 'trailing_input')"))
    raw = F.when(fits, F.expr("regexp_extract(value, pattern, capture)"))
    return t.withColumn("failure", failure).withColumn("raw", raw).withColumn("normal", normalised(F.col("field_type"), F.col("raw"))).drop("pattern", "prefixes", "capture")


def scopes(field_rows: DataFrame) -> DataFrame:
    """message_id, message_type, seq_path, seq_index of every sequence occurrence that a message opens."""
    return field_rows.where("seq_index <> '$'").select("message_id", "message_type", "seq_path", "seq_index").distinct()


def cardinality(field_rows: DataFrame, matches: DataFrame, rule_rows: DataFrame) -> DataFrame:
    """message_id, rule_ord, seq_index, found of each rule in each scope of its path: root rules once per message."""
    r = F.broadcast(rule_rows.select("message_type", "rule_ord", F.explode(F.split("path", r"\|")).alias("seq_path"), "name", "required", "min", "max"))
    root = field_rows.select("message_id", "message_type").distinct().select("message_id", "message_type", F.lit("$").alias("seq_path"), F.lit("$").alias("seq_index"))
    wanted = scopes(field_rows).unionByName(root).join(r, ["message_type", "seq_path"])
    counts = matches.groupBy("message_id", "rule_ord", "seq_index").agg(F.count(F.lit(1)).alias("found"))
    return wanted.join(counts, ["message_id", "rule_ord", "seq_index"], "left").withColumn("found", F.coalesce("found", F.lit(0)))


def missing_required(counted: DataFrame) -> DataFrame:
    return counted.where("required and found = 0").selectExpr("message_id", "'missing_required' as kind", "concat_ws(' ', seq_index, name) as detail")


def bad_cardinality(counted: DataFrame) -> DataFrame:
    least = F.coalesce("min", F.when(F.col("required"), 1).otherwise(0))
    return counted.where((F.col("found") < least) | (F.col("found") > F.col("max"))).selectExpr("message_id", "'cardinality' as kind", "concat_ws(' ', seq_index, name, cast(found as string)) as detail")


def opened_sequences(field_rows: DataFrame) -> DataFrame:
    """message_id, message_type, name, parent (a name, or $), parent_index of every sequence opened."""
    return field_rows.where("tag = '16R'").select("message_id", "message_type", F.col("value").alias("name"), F.regexp_extract("seq_path", r"([^/]+)$", 1).alias("parent"), F.col("seq_index").alias("parent_index"))


def sequence_errors(field_rows: DataFrame, sequence_rows: DataFrame) -> DataFrame:
    """Unknown sequences, sequences under a wrong parent, and too many or few of one under one parent occurrence."""
    opened = opened_sequences(field_rows)
    known = F.broadcast(sequence_rows)
    joined = opened.join(known, ["message_type", "name"], "left")
    unknown = joined.where("parents is null").select("message_id", "name").distinct().selectExpr("message_id", "'unknown_sequence' as kind", "name as detail")
    astray = joined.where("parents is not null and not array_contains(if(size(parents) = 0, array('$'), parents), parent)").selectExpr("message_id", "'wrong_parent' as kind", "concat(name, ' in ', parent) as detail")
    counts = opened.groupBy("message_id", "message_type", "parent_index", "name").agg(F.count(F.lit(1)).alias("found")).join(known, ["message_type", "name"])
    most = F.coalesce("max", F.when(~F.col("repeat"), 1))
    many = counts.where((F.col("found") > most) | (F.col("found") < F.col("min"))).selectExpr("message_id", "'sequence_cardinality' as kind", "concat_ws(' ', parent_index, name, cast(found as string)) as detail")
    return unknown.unionByName(astray).unionByName(many)


def capture_errors(captures: DataFrame) -> DataFrame:
    return captures.where("failure is not null").selectExpr("message_id", "concat('capture_', failure) as kind", "concat_ws(' ', seq_index, tag, value) as detail")


def errors(messages: DataFrame, catalog: Catalog = CATALOG) -> DataFrame:
    """message_id, kind, detail of all defects of messages. The field rows are written once, as every check reads them."""
    spark = messages.sparkSession
    rows = written(structure.field_rows(messages), "fields")
    rule_rows = rules(spark, catalog)
    matches = matched(rows, rule_rows)
    counted = cardinality(rows, matches, rule_rows)
    out = structure.diagnostics(messages).select("message_id", "kind", "detail")
    for more in (missing_required(counted), bad_cardinality(counted), sequence_errors(rows, sequences(spark, catalog)), capture_errors(captured(matches, compiled(spark, catalog))), without_rules(messages, rule_rows)):
        out = out.unionByName(more)
    return out


def without_rules(messages: DataFrame, rule_rows: DataFrame, fail: bool = False) -> DataFrame:
    """Messages of types that no rule is for; if fail, an error as soon as there is one. Rules are bounded reference data."""
    known = F.broadcast(rule_rows.select("message_type").distinct())
    if fail and (first := messages.join(known, "message_type", "left_anti").select("message_type").first()):
        raise ValueError(f"no rules for messages of type {first[0]}")
    return messages.join(known, "message_type", "left_anti").selectExpr("message_id", "'no_rules' as kind", "message_type as detail")


def tag_coverage(field_rows: DataFrame, rule_rows: DataFrame) -> DataFrame:
    """Per message: tags, how many some rule of the type is for, and the others in order."""
    known = F.broadcast(expanded(rule_rows).select("message_type", "tag_key").distinct().withColumn("known", F.lit(True)))
    tags = field_rows.where("tag not in ('16R', '16S')").select("message_id", "message_type", F.upper("tag").alias("tag_key")).distinct().join(known, ["message_type", "tag_key"], "left")
    return tags.groupBy("message_id", "message_type").agg(F.count(F.lit(1)).alias("tags"), F.count("known").alias("matched"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("known").isNull(), F.col("tag_key")))), ",").alias("unknown"))


def catalog_issues(rule_rows: DataFrame, sequence_rows: DataFrame, type_rows: DataFrame) -> DataFrame:
    """kind, detail of what is wrong with a catalog, for reading messages and for rendering them. A type without a pattern is a row of
    type_rows with a null kind; a message type whose rules are given twice repeats their numbers."""
    names = type_rows.select(F.col("name").alias("field_type")).distinct()
    where = F.concat_ws(" ", "message_type", F.col("rule_ord").cast("string"))
    issue = lambda df, kind: df.select(F.lit(kind).alias("kind"), where.alias("detail"))
    known = sequence_rows.select("message_type", F.col("name").alias("last")).distinct()
    # Every part of every alternative of a path must be a sequence.
    parts = rule_rows.select("message_type", "rule_ord", F.explode(F.split("path", r"[|/]")).alias("last")).where("last <> '$'")
    qualified = type_rows.where("word = 'qualifier'").select("name").distinct()
    used = rule_rows.where("qualifier is null").select("message_type", "rule_ord", F.explode(F.array_append(F.coalesce(F.map_values("option_types"), F.array().cast("array<string>")), F.col("field_type"))).alias("name"))
    parents = sequence_rows.select("message_type", "name", F.explode("parents").alias("last")).where("last <> '$'").join(known, ["message_type", "last"], "left_anti")
    concrete = F.col("tag").rlike("[A-Za-z]$")
    options = F.explode(F.map_entries("option_types"))
    unknown_option = rule_rows.where("option_types is not null").select("message_type", "rule_ord", options.alias("e")).select("message_type", "rule_ord", F.col("e.value").alias("field_type")).join(names, "field_type", "left_anti")
    twice = rule_rows.groupBy("message_type", "entity", "path", "column").agg(F.count(F.lit(1)).alias("n"), F.min("rule_ord").alias("rule_ord")).where("n > 1")
    out = [
        issue(rule_rows.join(names, "field_type", "left_anti"), "unknown_type"), issue(unknown_option, "unknown_option_type"), issue(parts.join(known, ["message_type", "last"], "left_anti").select("message_type", "rule_ord").distinct(), "unknown_path"),
        parents.select(F.lit("unknown_parent").alias("kind"), F.concat_ws(" ", "message_type", "name").alias("detail")), issue(rule_rows.where("min > max"), "bad_min_max"), issue(rule_rows.where(concrete & F.col("options").isNotNull()), "options_on_concrete_tag"),
        issue(rule_rows.where("entity = '' or column = ''"), "empty_mapping"), type_rows.groupBy("name", "step").count().where("count > 1").select("name").distinct().select(F.lit("duplicate_type").alias("kind"), F.col("name").alias("detail")),
        issue(rule_rows.where(F.col("render_option").isNotNull() & ~F.coalesce(F.array_contains("options", F.col("render_option")), F.lit(False))), "render_option"), issue(rule_rows.where((F.size("options") > 1) & F.col("render_option").isNull()), "render_option_missing"),
        issue(twice, "duplicate_mapping"), issue(used.join(qualified, "name").select("message_type", "rule_ord").distinct(), "missing_qualifier"),
        type_rows.groupBy("name").agg(F.count("kind").alias("n")).where("n = 0").select(F.lit("empty_pattern").alias("kind"), F.col("name").alias("detail")),
        rule_rows.groupBy("message_type", "rule_ord").count().where("count > 1").select("message_type").distinct().select(F.lit("duplicate_message").alias("kind"), F.col("message_type").alias("detail")),
    ]
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def coverage_report(rule_rows: DataFrame, sequence_rows: DataFrame) -> DataFrame:
    """Per message type: counts of sequences, fields, required, bounded, optioned and rendered rules, entities, and the percent of
    rules that a message can be rendered from."""
    s = sequence_rows.groupBy("message_type").agg(F.count(F.lit(1)).alias("sequences"))
    r = rule_rows.groupBy("message_type").agg(
        F.count(F.lit(1)).alias("fields"), F.count_if("required").alias("required"), F.count_if(F.col("min").isNotNull() | F.col("max").isNotNull()).alias("bounded"), F.count_if(F.size("options") > 0).alias("with_options"),
        F.count_if(F.col("options").isNull() | F.col("render_option").isNotNull()).alias("rendered"), F.count_if((F.size("options") > 1) & F.col("render_option").isNull()).alias("ambiguous"), F.count_if(F.col("qualifier").isNull()).alias("without_qualifier"), F.countDistinct("entity").alias("entities"),
    )
    percent = F.when(F.col("fields") == 0, 100.0).otherwise(F.round(100.0 * F.col("rendered") / F.col("fields"), 2))
    return r.join(s, "message_type", "left").withColumn("sequences", F.coalesce("sequences", F.lit(0))).withColumn("percent", percent)


def conflicts(*type_rows: DataFrame) -> DataFrame:
    """Names of field types that catalogs define differently."""
    each = [t.groupBy("name").agg(F.to_json(F.array_sort(F.collect_list(F.struct("step", "kind", "word", "class", "length")))).alias("pattern")) for t in type_rows]
    both = each[0]
    for more in each[1:]:
        both = both.unionByName(more)
    return both.groupBy("name").agg(F.countDistinct("pattern").alias("patterns")).where("patterns > 1")


def column_type(field_type: Column) -> Column:
    """DATE, DECIMAL or TEXT by the name of a field type."""
    return F.when(field_type.contains("date") & ~field_type.contains("datetime") & ~field_type.contains("text"), "DATE").when(field_type.contains("amount") | field_type.contains("quantity"), "DECIMAL(38,12)").otherwise("TEXT")


def layout(rule_rows: DataFrame) -> DataFrame:
    """entity, column, required (all its rules require it), type (TEXT where rules differ)."""
    grouped = rule_rows.groupBy("entity", "column").agg(F.bool_and("required").alias("required"), F.collect_set(column_type(F.col("field_type"))).alias("ts"))
    return grouped.select("entity", "column", "required", F.when(F.size("ts") == 1, F.col("ts")[0]).otherwise("TEXT").alias("type"))


