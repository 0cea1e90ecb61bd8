"""Security rules. Each rule turns flows into alert rows of one common schema.

Group rules read the endpoint roll-up instead of the raw flows: ports and targets are counted
on already distinct (user, source, destination, port) rows, and a hot source is spread over
its destinations before the last aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowloom import schema as S
from flowloom.functions import quantiles as Q
from flowloom.functions import scalars as X
from flowloom.operators.common import endpoints, grouped, rows, span_seconds, sum_bytes
from flowloom.session import durable

RULES = ["reconnaissance", "sensitive_service", "traffic_anomaly", "off_hours_activity", "prompt_injection",
         "ai_agent_activity", "web_payload_attack", "dns_tunneling", "data_exfiltration", "port_sweep", "beaconing"]
ALIASES = {"brute_force": "port_sweep"}
ACTIONS = {
    "reconnaissance": "throttle the source and confirm before isolating it",
    "sensitive_service": "check the operator's permission, otherwise block the source",
    "traffic_anomaly": "throttle first and review transfers and backups",
    "off_hours_activity": "compare with the timetable, otherwise ask for a second factor",
    "prompt_injection": "isolate the request and review it by hand",
    "ai_agent_activity": "limit by rate and behaviour, not by client name",
    "web_payload_attack": "block the source and check the target's logs",
    "dns_tunneling": "inspect the query names and block unknown resolvers",
    "data_exfiltration": "review targets and transferred content",
    "port_sweep": "block the source for this port and check the targets' logs",
    "beaconing": "check the target's reputation and block it if needed",
}
TEXT_RULES = {
    "prompt_injection": (S.INJECTION_TERMS, 82),
    "ai_agent_activity": (S.AGENT_TERMS, 64),
    "web_payload_attack": (S.WEB_ATTACK_TERMS, 88),
}
#: Users up to which the built-in exact median may hold one value each in memory.
MEDIAN_USERS = 1_000_000
ALL_TERMS = [term for terms, _ in TEXT_RULES.values() for term in terms]


def clean_flows(df: DataFrame) -> DataFrame:
    """Numbers coerced (junk is 0), text nulls to ``unknown``, ``hour`` added."""
    def number(name: str, kind: str) -> Column:
        return F.coalesce(X.whole_number(F.col(name).cast("string")).try_cast(kind), F.lit(0).cast(kind))

    changes = {c: number(c, k) for c, k in (("bytes", "bigint"), ("src_port", "int"), ("dst_port", "int"))
               if c in df.columns}
    changes.update({c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
                    for c in ("user", "src_ip", "dst_ip", "protocol", "app_category") if c in df.columns})
    if "timestamp" in df.columns:
        stamp = F.col("timestamp").try_cast("timestamp_ntz")
        changes.update(timestamp=stamp, hour=F.hour(stamp))
    return df.withColumns(changes)


def _pair() -> Column:
    return F.concat(F.col("user"), F.lit(" / "), F.col("src_ip"))


def _label(text: str, value: Column) -> Column:
    return F.concat(F.lit(text + "="), value.cast("string"))


def _one_digit(value: Column) -> Column:
    return F.format_string("%.1f", X.round_half_up(value, 1))


def _alert(frame: DataFrame, kind: str, score: Column, entity: Column, evidence: list[Column],
           target_type: str, reason: Column | None = None, key: Column | None = None) -> DataFrame:
    entity = entity.cast("string")
    reason = F.lit(kind) if reason is None else reason
    return frame.select(
        F.lit(RULES.index(kind) + 1).alias("rule_no"),
        F.lit(kind).alias("type"),
        score.cast("int").alias("score"),
        X.rule_severity(score).alias("severity"),
        reason.alias("title"),
        entity.alias("entity"),
        F.array_join(F.array(*evidence), "; ").alias("evidence"),
        F.lit(ACTIONS[kind]).alias("suggested_action"),
        F.lit(target_type).alias("target_type"),
        (F.col("src_ip") if target_type == "src_ip" else F.col("user")).alias("target"),
        F.concat_ws("|", F.lit(kind), entity, reason, F.lit("") if key is None else key).alias("alert_key"),
    )


def reconnaissance(flows: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    ends = endpoints(flows) if ends is None else ends
    g = ends.groupBy("user", "src_ip").agg(
        F.sum("n").alias("packets"), F.countDistinct("dst_port").alias("ports"),
        F.countDistinct("dst_ip").alias("targets"))
    hit = (F.col("ports") >= 8) | (F.col("targets") >= 10) | ((F.col("packets") >= 40) & (F.col("ports") >= 5))
    score = F.least(F.lit(95), 45 + F.col("ports") * 4 + F.col("targets") * 3)
    return _alert(g.where(hit), "reconnaissance", score, _pair(),
                  [_label("ports", F.col("ports")), _label("targets", F.col("targets")),
                   _label("rows", F.col("packets"))], "src_ip")


def port_sums(ends: DataFrame) -> DataFrame:
    """One row per (user, source, port): what the sensitive-service and sweep rules read. One endpoint row is one target."""
    return ends.groupBy("user", "src_ip", "dst_port").agg(
        rows("targets"), F.sum("n").alias("attempts"), F.min("first_ts").alias("a"), F.max("last_ts").alias("b"))


def sensitive_service(flows: DataFrame, per_port: DataFrame | None = None) -> DataFrame:
    per_port = port_sums(endpoints(flows)) if per_port is None else per_port
    g = per_port.where(F.col("dst_port").isin(list(S.SENSITIVE_PORTS))).withColumnRenamed("attempts", "hits")
    score = F.least(F.lit(90), 38 + F.col("hits") * 5 + F.col("targets") * 8)
    service = X.port_lookup(F.col("dst_port"), S.SENSITIVE_PORTS, "sensitive service")
    reason = F.concat(F.lit("sensitive_service "), service, F.lit("/"), F.col("dst_port").cast("string"))
    return _alert(g.where((F.col("hits") >= 3) | (F.col("targets") >= 2)), "sensitive_service", score, _pair(),
                  [_label("hits", F.col("hits")), _label("targets", F.col("targets"))], "src_ip", reason)


def user_sums(ends: DataFrame) -> DataFrame:
    """One row per user: what the volume, night and DNS rules read."""
    dns = F.col("dst_port") == 53
    return ends.groupBy("user").agg(
        F.sum("bytes").alias("bytes"), F.sum("night_rows").alias("night_rows"), F.sum("night_bytes").alias("night_bytes"),
        F.coalesce(F.sum(F.when(dns, F.col("n"))), F.lit(0)).alias("dns_rows"), F.coalesce(F.sum(F.when(dns, F.col("bytes"))), F.lit(0)).alias("dns_bytes"))


def traffic_anomaly(flows: DataFrame, largest: int = 5, per_user: DataFrame | None = None) -> DataFrame:
    """Among the ``largest`` users: five times the median user and at least 10 MiB.

    Works on flows, on the endpoint roll-up, or on :func:`user_sums`: only users and bytes are read.
    """
    if per_user is None:
        per_user = durable(grouped(flows, "user").agg(sum_bytes()))
    population = per_user.count()
    # The built-in holds all values in one buffer; beyond this many users the ranks are narrowed down instead.
    middle = per_user.agg(F.percentile("bytes", 0.5)) if population <= MEDIAN_USERS else Q.exact_quantiles(per_user, "bytes", {"m": 0.5})
    median = F.greatest(F.floor(middle.scalar()), F.lit(1)).cast("double")
    biggest = per_user.select("user", "bytes").orderBy(F.col("bytes").desc(), F.col("user")).limit(largest).withColumn(
        "ratio", F.col("bytes").cast("double") / median)
    hit = (F.lit(population) >= 2) & (F.col("ratio") >= 5.0) & (F.col("bytes") >= 10 * S.MIB)
    score = F.least(F.lit(85).cast("bigint"), F.floor(F.lit(35.0) + F.col("ratio") * 6.0))
    return _alert(biggest.where(hit), "traffic_anomaly", score, F.col("user"),
                  [_label("bytes", X.human_bytes_wide("bytes")), _label("times_median", _one_digit(F.col("ratio")))],
                  "user")


def off_hours(flows: DataFrame, per_user: DataFrame | None = None) -> DataFrame:
    if per_user is None:
        g = grouped(flows.where(F.hour("timestamp").between(0, 5)), "user").agg(rows("packets"), sum_bytes())
    else:
        g = per_user.where("night_rows > 0").select("user", F.col("night_rows").alias("packets"), F.col("night_bytes").alias("bytes"))
    hit = (F.col("packets") >= 10) | (F.col("bytes") >= 5 * S.MIB)
    return _alert(g.where(hit), "off_hours_activity", F.least(F.lit(78), 36 + F.col("packets") * 2), F.col("user"),
                  [_label("rows", F.col("packets")), _label("bytes", X.human_bytes_wide("bytes"))], "user")


def indicator_text(df: DataFrame) -> Column:
    """Lower-cased text of all candidate columns that are present."""
    present = [c for c in S.TEXT_COLUMNS if c in df.columns]
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in present]))


def text_indicators(flows: DataFrame, shown: int = 5) -> DataFrame:
    """Per-row alerts of the three text rules in one scan; evidence is the first ``shown`` terms."""
    # A cheap yes/no test first; terms are listed for its hits only.
    found = flows.where(X.has_any_term(indicator_text(flows), ALL_TERMS)).withColumn("_text", indicator_text(flows))
    parts = F.array(*[F.struct(F.lit(name).alias("kind"), F.lit(score).alias("score"),
                               X.matched_terms(F.col("_text"), terms).alias("terms"))
                      for name, (terms, score) in TEXT_RULES.items()])
    hits = found.select("flow_id", "user", "src_ip", F.inline(parts)).where(F.size("terms") > 0)
    kind = F.col("kind")
    number = F.lit(0)
    action = F.lit("")
    for name in TEXT_RULES:
        number = F.when(kind == name, RULES.index(name) + 1).otherwise(number)
        action = F.when(kind == name, ACTIONS[name]).otherwise(action)
    return hits.select(
        number.alias("rule_no"), kind.alias("type"), F.col("score").cast("int").alias("score"),
        X.rule_severity(F.col("score")).alias("severity"), kind.alias("title"), _pair().alias("entity"),
        F.concat(F.lit("terms="), F.array_join(F.slice("terms", 1, shown), ", ")).alias("evidence"),
        action.alias("suggested_action"), F.lit("src_ip").alias("target_type"), F.col("src_ip").alias("target"),
        F.concat_ws("|", kind, _pair(), kind, F.col("flow_id").cast("string")).alias("alert_key"))


def text_rule_hits(df: DataFrame, key: str, text: Column, shown: int = 5) -> DataFrame:
    """The same three rules over any text table: (key, rule, the first ``shown`` terms found)."""
    parts = F.array(*[F.struct(F.lit(name).alias("rule"),
                               F.array_join(F.slice(X.matched_terms(F.col("_text"), terms), 1, shown), ", ").alias("terms"))
                      for name, (terms, _) in TEXT_RULES.items()])
    return (df.where(X.has_any_term(F.lower(text), ALL_TERMS)).select(F.col(key), F.lower(text).alias("_text"))
            .select(key, F.inline(parts)).where(F.col("terms") != ""))


def dns_tunneling(flows: DataFrame, per_user: DataFrame | None = None) -> DataFrame:
    if per_user is None:
        g = grouped(flows.where(F.col("dst_port") == 53), "user").agg(rows("queries"), sum_bytes())
    else:
        g = per_user.where("dns_rows > 0").select("user", F.col("dns_rows").alias("queries"), F.col("dns_bytes").alias("bytes"))
    mean = F.col("bytes").cast("double") / F.col("queries").cast("double")
    hit = (F.col("queries") > 100) & (mean > 100.0)
    score = F.least(F.lit(95).cast("bigint"), 50 + F.least(F.floor(F.col("queries") / 10), F.lit(30))
                    + F.least(F.floor(mean / 10.0), F.lit(15)))
    return _alert(g.where(hit), "dns_tunneling", score, F.col("user"),
                  [_label("queries", F.col("queries")), _label("bytes", X.human_bytes_wide("bytes")),
                   _label("mean", _one_digit(mean))], "user")


def data_exfiltration(flows: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    ends = endpoints(flows) if ends is None else ends
    g = ends.where(F.col("dst_port").isin(S.EXFILTRATION_PORTS)).groupBy("user", "dst_port").agg(
        F.sum("bytes").alias("bytes"), F.countDistinct("dst_ip").alias("targets"))
    score = F.least(F.lit(92).cast("bigint"), 45 + F.least(F.floor(F.col("bytes") / (5 * S.MIB)), F.lit(35))
                    + F.col("targets") * 3)
    reason = F.concat(F.lit("data_exfiltration port "), F.col("dst_port").cast("string"))
    return _alert(g.where(F.col("bytes") >= 10 * S.MIB), "data_exfiltration", score, F.col("user"),
                  [_label("port", F.col("dst_port")), _label("bytes", X.human_bytes_wide("bytes")),
                   _label("targets", F.col("targets"))], "user", reason)


def port_sweep(flows: DataFrame, per_port: DataFrame | None = None) -> DataFrame:
    """One port on many targets; also known as ``brute_force``."""
    g = port_sums(endpoints(flows)) if per_port is None else per_port
    span = F.coalesce(span_seconds(F.col("a"), F.col("b")), F.lit(0.0))
    rate = F.col("attempts").cast("double") / F.greatest(span, F.lit(1.0))
    score = F.least(F.lit(88).cast("bigint"), 40 + F.least(F.col("targets") * 3, F.lit(25))
                    + F.least(F.floor(rate * 5.0), F.lit(15)))
    reason = F.concat(F.lit("port_sweep port "), F.col("dst_port").cast("string"))
    return _alert(g.where((F.col("targets") >= 5) & (F.col("attempts") >= 10)), "port_sweep", score, _pair(),
                  [_label("port", F.col("dst_port")), _label("targets", F.col("targets")),
                   _label("attempts", F.col("attempts")), _label("per_second", _one_digit(rate))], "src_ip", reason)


def connection_gaps(flows: DataFrame, chunk_seconds: int = 300) -> DataFrame:
    """Positive gaps between consecutive flows of (user, source, destination), as moments.

    Equal timestamps give no gap, so flows are first reduced to distinct timestamps. The
    ordered step then runs inside time chunks: a hot triple is cut into many small sorts. The
    gap across a chunk border comes from the chunk summaries, one row per chunk in use.
    """
    keys = ["user", "src_ip", "dst_ip"]
    us = X.epoch_micros(F.col("timestamp"))
    spread = flows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*keys, "timestamp"])).select(
        *keys, us.alias("us"), F.floor(us / F.lit(chunk_seconds * 1_000_000)).alias("chunk")).repartition(*keys, "chunk")
    # One shuffle serves the distinct timestamps, the ordering and the chunk summaries.
    moments = spread.groupBy(*keys, "chunk", "us").agg(rows("n"))
    inside = moments.withColumn(
        "gap", F.col("us") - F.lag("us").over(Window.partitionBy(*keys, "chunk").orderBy("us")))

    def moments_of(gap: Column) -> list[Column]:
        seconds = gap.cast("double") / F.lit(1e6)
        return [F.count(gap).alias("gaps"), F.coalesce(F.sum(gap), F.lit(0).cast("bigint")).alias("sum_us"),
                F.coalesce(F.sum(seconds * seconds), F.lit(0.0)).alias("sum_sq")]

    chunks = inside.groupBy(*keys, "chunk").agg(
        F.sum("n").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"),
        *moments_of(F.col("gap")))
    border = chunks.withColumn(
        "border", F.col("first_us") - F.lag("last_us").over(Window.partitionBy(*keys).orderBy("chunk")))
    edge = F.col("border").cast("double") / F.lit(1e6)
    return border.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        (F.sum("gaps") + F.count("border")).alias("gaps"),
        (F.sum("sum_us") + F.coalesce(F.sum("border"), F.lit(0))).alias("sum_us"),
        (F.sum("sum_sq") + F.coalesce(F.sum(edge * edge), F.lit(0.0))).alias("sum_sq"))


def beaconing(flows: DataFrame) -> DataFrame:
    g = connection_gaps(flows).where((F.col("n") >= 5) & (F.col("gaps") >= 4))
    count = F.col("gaps").cast("double")
    mean = F.col("sum_us").cast("double") / F.lit(1e6) / count
    variance = (F.col("sum_sq") - count * F.col("mean") * F.col("mean")) / (count - 1.0)
    # Six digits: the sum order must not decide a threshold.
    g = g.withColumn("mean", mean).withColumn(
        "std", X.round_half_up(F.sqrt(F.greatest(variance, F.lit(0.0))), 6))
    hit = (F.col("mean") >= 10.0) & (F.col("std") < F.col("mean") * 0.3)
    score = F.least(F.lit(85).cast("bigint"), 40 + F.least(F.floor(F.lit(30.0) / F.greatest(F.col("mean"), F.lit(1.0))), F.lit(20))
                    + F.greatest(F.lit(0).cast("bigint"), 25 - F.floor(F.col("std"))))
    return _alert(g.where(hit), "beaconing", score, _pair(),
                  [_label("target", F.col("dst_ip")), _label("rows", F.col("n")),
                   _label("mean_gap", _one_digit(F.col("mean"))), _label("std_gap", _one_digit(F.col("std")))],
                  "src_ip", key=F.col("dst_ip"))


def all_alerts(flows: DataFrame) -> DataFrame:
    """Union of all rules.

    The endpoint roll-up is written once, and from it the sums per user (three rules) and per user, source and port
    (two rules). Text and beacon rules scan the flows themselves, so the table is read three times in all.
    """
    ends = durable(endpoints(flows))
    per_user, per_port = durable(user_sums(ends)), durable(port_sums(ends))
    parts = [reconnaissance(flows, ends), sensitive_service(flows, per_port), traffic_anomaly(ends, per_user=per_user), off_hours(flows, per_user),
             text_indicators(flows), dns_tunneling(flows, per_user), data_exfiltration(flows, ends), port_sweep(flows, per_port),
             beaconing(flows)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def with_alert_ids(alerts: DataFrame) -> DataFrame:
    """Consecutive ids SEC-0001, SEC-0002, ... in rule order, numbered without one global sort.

    Alerts are ranked inside (rule, hash prefix) buckets; the bucket offsets come from a
    running sum over at most 11 x 4096 count rows. Counting and ranking both read the alerts,
    so they are written once first.
    """
    digest = durable(alerts).withColumn("digest", F.md5("alert_key")).withColumn("bucket", F.substring("digest", 1, 3))
    sizes = digest.groupBy("rule_no", "bucket").agg(rows("size"))
    before = F.coalesce(F.sum("size").over(
        Window.orderBy("rule_no", "bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("rule_no", "bucket", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("rule_no", "bucket").orderBy("digest"))
    numbered = digest.withColumn("r", inside).join(F.broadcast(offsets), ["rule_no", "bucket"])
    number = (F.col("before") + F.col("r")).cast("string")
    padded = F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)
    return numbered.withColumn("id", F.concat(F.lit("SEC-"), padded)).drop("digest", "bucket", "before", "r")


def with_severity_overrides(alerts: DataFrame, overrides: dict[str, str]) -> DataFrame:
    return alerts.withColumn("severity", X.severity_with_overrides(F.col("type"), F.col("score"), overrides))


def block_list(alerts: DataFrame) -> DataFrame:
    """Targets of alerts scoring 70 or more, with action and time to live."""
    g = alerts.where((F.col("score") >= 70) & F.col("target").isNotNull()).groupBy("target_type", "target").agg(
        F.max("score").alias("max_score"), F.array_join(F.array_sort(F.collect_set("title")), ", ").alias("reasons"))
    score = F.col("max_score")
    return g.withColumns({
        "action": F.when(score >= 85, "quarantine").when(score >= 75, "rate_limit").otherwise("step_up_auth"),
        "ttl_minutes": F.when(score >= 85, 30).when(score >= 75, 15).otherwise(10)})


def risk_summary(alerts: DataFrame) -> DataFrame:
    g = alerts.agg(F.least(F.coalesce(F.max("score"), F.lit(0)), F.lit(100)).alias("risk_score"), rows("total_alerts"),
                   *[F.count_if(F.col("severity") == s).alias(f"{s}_alerts")
                     for s in ("critical", "high", "medium", "low")])
    return g.withColumn("risk_level", X.rule_severity(F.col("risk_score")))


def report(flows: DataFrame) -> dict[str, DataFrame]:
    """Alerts, block list and summary, all from alerts that are evaluated once."""
    alerts = with_alert_ids(all_alerts(flows))
    return {"alerts": alerts, "block_list": block_list(alerts), "summary": risk_summary(alerts)}


def attack_sources(flows: DataFrame, blocked: DataFrame) -> DataFrame:
    """Distinct sources, most frequent destination port (lowest wins a tie) and block-list size."""
    per_port = grouped(flows, "dst_port").agg(rows("n"))
    best = per_port.agg(F.max(F.struct("n", (-F.col("dst_port")).alias("neg"))).alias("b")).select(
        (-F.col("b.neg")).alias("p"))
    top_port = best.scalar()
    service = X.port_lookup(F.col("top_port"), S.ATTACK_SERVICE_NAMES, "TCP/UDP")
    return (flows.agg(F.countDistinct("src_ip").alias("sources"))
            .withColumns({"top_port": top_port, "blocked": blocked.agg(rows("c")).scalar()})
            .select("sources", "top_port", service.alias("service"), "blocked"))


def address_reputation(flows: DataFrame, table: DataFrame, column: str = "dst_ip") -> DataFrame:
    """Distinct addresses joined to a reputation table; private prefixes are clean, the rest unknown.

    The table's size decides the join: small tables are broadcast by the optimizer, others shuffled.
    """
    found = grouped(flows, column).agg(rows("packets")).withColumnRenamed(column, "ip")
    inside = F.col("ip").rlike(r"^(10\.|192\.168\.|172\.16\.)")
    return found.join(table.select("ip", "reputation", "score"), "ip", "left").select(
        "ip", "packets",
        F.coalesce(F.col("reputation"), F.when(inside, "clean").otherwise("unknown")).alias("reputation"),
        F.coalesce(F.col("score"), F.lit(0)).cast("int").alias("score"))
