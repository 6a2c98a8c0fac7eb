"""Log cleaning and splitting queries, read from raw JSON text."""

from pyspark.sql import functions as F

from millrace.plans.traffic import repaired_records, traffic_topics
from millrace.queries import views as v
from millrace.queries.registry import query, with_views

REPAIR_SQL = v.PAGE_SQL + """,
since as (
  select mid, case when is_new = '1' then cast(et as date) else cast(et as date) - 1 end as since from page
  qualify row_number() over (partition by mid order by ts_ms, event_id) = 1),
fixed as (
  select page.* exclude (is_new),
         case when is_new = '1' and cast(et as date) <> since then '0' else is_new end as is_new
  from page join since using (mid))"""


def raw_log(spark, sf_dir):
    """App log messages as text, one per event; the number of the event orders equal times."""
    return log_text(v.app_log(spark, sf_dir))


def log_text(log):
    body = F.struct(*[c for c in log.columns if c != "event_id"])
    return log.select("event_id", F.to_json(body).alias("value"))


ORDER, KEEP = ["ts", "event_id"], ["event_id"]


@query("log_new_visitor_fix", with_views(REPAIR_SQL, select="select event_id, mid, is_new from fixed"))
def log_new_visitor_fix(spark, sf_dir):
    return repaired_records(raw_log(spark, sf_dir), ORDER, KEEP).select("event_id", "common.mid", "common.is_new")


@query("log_split_pages", with_views(REPAIR_SQL, select="""
  select event_id, mid, uid, is_new, page_id, last_page_id, item_type, cast(k as varchar) as item, during_time, ts_ms as ts
  from fixed where event_type in ('view', 'click', 'purchase')"""))
def log_split_pages(spark, sf_dir):
    pages = traffic_topics(raw_log(spark, sf_dir), ORDER, KEEP)["page"]
    return pages.select("event_id", "common.mid", "common.uid", "common.is_new", "page.page_id",
                        "page.last_page_id", "page.item_type", "page.item", "page.during_time", "ts")


@query("log_split_explode", with_views(REPAIR_SQL, select="""
  select event_id, 'display' as part, mid, ch, is_new, cast(k + p as varchar) as item, cast(p + 1 as varchar) as pos,
         cast(null as varchar) as action_id, cast(ts_ms as varchar) as ts
  from fixed, (values (0), (1)) t(p) where event_type in ('view', 'error')
  union all
  select event_id, 'action', mid, ch, is_new, cast(k as varchar), null, 'like', cast(ts_ms as varchar)
  from fixed where event_type in ('click', 'view')"""))
def log_split_explode(spark, sf_dir):
    parts = traffic_topics(raw_log(spark, sf_dir), ORDER, KEEP)

    def flat(part):
        return parts[part].select("event_id", F.lit(part).alias("part"), *[
            F.col("row")[c].alias(c) for c in ("mid", "ch", "is_new", "item", "pos", "action_id", "ts")])

    return flat("display").unionByName(flat("action"))


@query("log_split_start_err", with_views(REPAIR_SQL, select="""
  select event_id, 'start' as part, cast(k as varchar) as code, 0 as displays, 0 as actions, false as has_page
  from fixed where event_type = 'signup'
  union all
  select event_id, 'err', cast(k as varchar), 0, 0, event_type = 'purchase'
  from fixed where event_type in ('error', 'purchase')"""))
def log_split_start_err(spark, sf_dir):
    parts = traffic_topics(raw_log(spark, sf_dir), ORDER, KEEP)
    start = parts["start"].select(
        "event_id", F.lit("start").alias("part"), F.col("start")["k"].alias("code"),
        F.coalesce(F.size("displays"), F.lit(0)).alias("displays"),
        F.coalesce(F.size("actions"), F.lit(0)).alias("actions"), F.col("page").isNotNull().alias("has_page"))
    err = parts["err"].select(
        "event_id", F.lit("err").alias("part"), F.col("err")["code"].alias("code"),
        F.lit(0).alias("displays"), F.lit(0).alias("actions"), F.col("page").isNotNull().alias("has_page"))
    return start.unionByName(err)
