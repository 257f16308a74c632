"""How the operators fit together, and the job that writes the four tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import cached_property

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cohortry.functions.inputs import fitted_shuffles
from cohortry.functions.lookups import Lookups
from cohortry.functions.staging import buckets_of, stage, stage_by, temporary_stages, without_users
from cohortry.operators import (
    crm,
    exclusions,
    mart_variants,
    nested,
    options,
    reports,
    rollup,
    scores,
)
from cohortry.rules import AGENTS, INTERNAL, Rules
from cohortry.sinks import Releases
from cohortry.sources import Sources


# Stores a table under a name and returns it as read back.
Writer = Callable[[DataFrame, str], DataFrame]


class Segmentation:
    """Every intermediate table of one run, built when first asked for.

    Tables that several others read are staged: order documents are parsed once and the order
    lines shuffled once. With `exclude=False` no user is left out, as for overall totals. `labels`
    names the rule set of the dimension table: "v3", or "v2" and "v1" from the order mart.
    """

    def __init__(self, sources: Sources, rules: Rules, exclude: bool = True, labels: str = "v3"):
        if labels not in ("v1", "v2", "v3"):
            raise ValueError(f"unknown label rules {labels!r}")
        self.sources = sources
        self.rules = rules
        self.exclude = exclude
        self.labels = labels
        self.lookups = Lookups(rules.fail_on_repeated_keys)
        self.documents = Observation()
        self._left_out: dict[tuple[str, ...], DataFrame] = {}

    # Exclusions

    @cached_property
    def agents(self) -> DataFrame:
        shared = exclusions.shared_address_buyers(self.sources.commerce_orders, self.rules)
        several = exclusions.multi_artist_buyers(
            self.sources.order_mart, self.sources.event_mart, self.rules
        )
        return exclusions.purchasing_agents(shared, several)

    def left_out(self, groups: Sequence[str]) -> DataFrame | None:
        """The users of some groups, staged once for all tables that leave out the same ones."""
        if not self.exclude or not groups:
            return None
        name = tuple(sorted(set(groups)))
        if name not in self._left_out:
            self._left_out[name] = stage(self._users_of(name), "excluded")
        return self._left_out[name]

    def _users_of(self, groups: tuple[str, ...]) -> DataFrame:
        if unknown := set(groups) - {INTERNAL, AGENTS}:
            raise ValueError(f"unknown groups of users: {sorted(unknown)}")
        if groups == (INTERNAL,):
            return self.sources.internal_accounts.select("user_id").distinct()
        if groups == (AGENTS,):
            return self.agents.select("user_id")
        return exclusions.excluded_users(self.sources.internal_accounts, self.agents)

    @cached_property
    def excluded(self) -> DataFrame | None:
        """Users left out of the labels."""
        return self.left_out(self.rules.label_exclusions)

    # Lookups

    @cached_property
    def events(self) -> DataFrame:
        return self.lookups.unique(
            self.sources.event_mart, "event_mart", "event_id", ["artist_id", "album_name"]
        )

    @cached_property
    def user_info(self) -> DataFrame:
        columns = ["country_code", "gender_type", "birth"]
        return self.lookups.unique(self.sources.user_info, "user_info", "user_id", columns)

    # Scores

    def eligible_orders(self) -> DataFrame:
        return scores.eligible_orders(
            self.sources.order_mart,
            self.events,
            self.left_out(self.rules.score_exclusions),
            self.rules.score_markets,
            self.rules.order_source,
        )

    def order_values(self) -> DataFrame:
        """F and M per user. Users are excluded when there is one row each."""
        lines = scores.market_orders(
            self.sources.order_mart, self.rules.score_markets, self.rules.order_source
        )
        spend = scores.event_spend(lines)
        values = scores.order_values(scores.with_event(spend, self.events))
        return without_users(values, self.left_out(self.rules.score_exclusions))

    def rfm_base(self) -> DataFrame:
        recent = scores.recency(self.sources.users, self.rules)
        return scores.rfm_base(recent, self.order_values())

    @cached_property
    def score(self) -> DataFrame:
        return scores.rfm_score(self.rfm_base(), self.rules.tiles)

    # Purchase labels

    @cached_property
    def offers(self) -> DataFrame:
        unique = self.lookups.unique
        table = nested.offer_lookup(
            unique(self.sources.event_data, "event_data", "id", ["product_event_type", "product_id"]),
            unique(self.sources.products, "products", "id", ["artist_id"]),
            unique(self.sources.artists, "artists", "id", ["name"]),
        )
        return stage(table, "offers")

    def paid_lines(self, seen: Observation | None = None) -> DataFrame:
        lines = nested.order_lines(self.sources.commerce_orders, self.rules, seen)
        return nested.paid_b2c_lines(lines, self.offers, self.rules)

    @cached_property
    def sku_matches(self) -> DataFrame:
        return options.option_sku_matches(self.sources.items, self.sources.skus)

    @cached_property
    def purchases(self) -> DataFrame:
        """Paid lines per user, artist and option, with the option's versions and ticket mark. They
        lie by user, as all that follows is by user."""
        bought = options.option_purchases(self.paid_lines(self.documents))
        if self.excluded is not None:
            bought = without_users(bought, self.excluded)
        # Not staged: it lies by option as it is grouped, so the join moves it no second time.
        catalog = options.option_catalog(self.sku_matches)
        return stage_by(options.match_options(bought, catalog), "purchases", "user_id")

    @cached_property
    def winners(self) -> DataFrame:
        return stage(
            nested.winners(self.sources.winner_groups, self.sources.commerce_orders), "winners"
        )

    @cached_property
    def bulk_buyers(self) -> DataFrame:
        return options.bulk_ticket_buyers(self.purchases, self.rules.bulk_ticket_qty)

    @cached_property
    def certain(self) -> DataFrame:
        """Users who are challengers whatever their quantities."""
        both = self.winners.select("user_id").unionByName(self.bulk_buyers)
        return stage(both.distinct(), "certain")

    def option_labels(self) -> DataFrame:
        return options.label_options(
            options.option_stats(self.purchases), self.certain, self.rules
        )

    @cached_property
    def artist_totals(self) -> DataFrame:
        labelled = options.label_purchases(self.purchases, self.certain, self.rules)
        return stage_by(rollup.artist_totals(labelled), "artist-totals", "user_id")

    def user_totals(self) -> DataFrame:
        return rollup.user_totals(self.artist_totals)

    def user_labels(self) -> DataFrame:
        return self.user_totals().filter(F.col("user_label").isNotNull()).select("user_id", "user_label")

    def final_dimension(self) -> DataFrame:
        users = self.user_totals()
        purchases = users.drop("user_label", "top_gmv")
        return rollup.final_dimension(
            purchases, self.user_labels(), self.certain, self.rules
        )

    def main_artist(self) -> DataFrame:
        names = nested.artist_names(self.offers)
        return rollup.main_artist_of(self.artist_totals, self.user_totals(), names)

    def build_dimension(self) -> DataFrame:
        if self.labels == "v1":
            return rollup.user_dimension(self.final_dimension_v1(), self.main_artist_v2())
        if self.labels == "v2":
            return self.dimension_v2()
        return rollup.user_dimension(self.final_dimension(), self.main_artist())

    @cached_property
    def dimension(self) -> DataFrame:
        return stage_by(self.build_dimension(), "dimension", "user_id")

    # Older label rules, from the order mart

    @cached_property
    def sku_counts(self) -> DataFrame:
        items = self.sources.items
        counts = options.sku_row_counts(items, self.sources.skus, buckets_of(items.sparkSession))
        return stage_by(counts, "sku-counts", *options.OPTION, dealt=True)

    @cached_property
    def mart_purchases(self) -> DataFrame:
        bought = mart_variants.mart_purchases(
            self.sources.order_mart,
            self.excluded,
            self.rules.retail_markets,
            self.rules.order_source,
        )
        return stage(bought, "mart-purchases")

    def option_stats_v2(self) -> DataFrame:
        return mart_variants.option_stats_v2(
            self.mart_purchases, self.events, self.sku_counts
        )

    def bulk_buyers_v2(self) -> DataFrame:
        return mart_variants.bulk_ticket_buyers_v2(
            self.mart_purchases, self.sku_counts, self.rules.bulk_ticket_qty
        )

    def final_dimension_v2(self) -> DataFrame:
        certain = stage(
            self.winners.select("user_id").unionByName(self.bulk_buyers_v2()).distinct(),
            "certain-v2",
        )
        labelled = options.label_options(self.option_stats_v2(), certain, self.rules)
        return rollup.final_dimension(
            mart_variants.user_purchases_v2(self.mart_purchases),
            rollup.user_labels(rollup.artist_labels(labelled)),
            certain,
            self.rules,
            "v2",
        )

    def main_artist_v2(self) -> DataFrame:
        return mart_variants.main_artist_v2(self.mart_purchases, self.events)

    def dimension_v2(self) -> DataFrame:
        return rollup.user_dimension(self.final_dimension_v2(), self.main_artist_v2())

    def option_stats_v1(self) -> DataFrame:
        bought = mart_variants.mart_purchases(
            self.sources.order_mart, None, self.rules.score_markets, self.rules.order_source
        )
        return mart_variants.option_stats_v1(bought, self.events, self.sku_counts)

    def final_dimension_v1(self) -> DataFrame:
        return mart_variants.final_dimension_v1(self.option_stats_v1(), self.winners, self.rules)

    # Merged tables

    def build_segment(self) -> DataFrame:
        return crm.user_segment(self.score_by_user, self.dimension, self.rules)

    @cached_property
    def segment(self) -> DataFrame:
        return stage(self.build_segment(), "segment")

    def profile(self) -> DataFrame:
        return crm.user_profile(self.sources.users, self.user_info, self.rules)

    def purchase_stats(self) -> DataFrame:
        excluded = self.left_out(self.rules.customer_exclusions)
        return crm.purchase_stats(self.sources.order_mart, excluded, self.rules)

    @cached_property
    def score_by_user(self) -> DataFrame:
        """The scores, lying by user as the tables that they are joined to."""
        return stage_by(self.score, "score", "user_id")

    def build_crm(self) -> DataFrame:
        """Four tables that lie by user: joining them shuffles nothing."""
        profile = stage_by(self.profile(), "profile", "user_id")
        stats = stage_by(self.purchase_stats(), "purchase-stats", "user_id")
        return crm.crm_users(profile, self.score_by_user, self.dimension, stats, self.rules)

    @cached_property
    def crm_users(self) -> DataFrame:
        return stage(self.build_crm(), "crm")

    def kpi_totals(self) -> DataFrame:
        """Overall totals: buyers and spend of every user, excluded ones too.

        A buyer has a score if spend is above 0, so neither tiles nor labels are needed.
        """
        everyone = Segmentation(self.sources, self.rules, exclude=False)
        buyers = everyone.rfm_base().filter(F.col("m_raw") > 0)
        customers = (
            self.profile()
            .join(buyers.select("user_id", F.lit(1).alias("r_score")), "user_id", "left")
            .join(everyone.purchase_stats(), "user_id", "left")
            .withColumn("total_gmv", F.coalesce("total_gmv", F.lit(0)))
        )
        return reports.kpi_totals(customers)


def run(
    sources: Sources,
    rules: Rules,
    write: Writer,
    labels: str = "v3",
) -> DataFrame:
    """Build the score, dimension, segment and customer tables, each replacing the last run's.

    All four are computed before the first is replaced. See `parquet_writer` and `table_writer` for
    `write`. Returns the check summary of the new customer table.
    """
    job = Segmentation(sources, rules, labels=labels)
    columns = ["user_id", "r_raw", "f_raw", "m_raw", "r_score", "f_score", "m_score"]
    with temporary_stages(sources.users.sparkSession):
        job.score = job.score_by_user
        made = {
            "user_rfm_score": job.score.select(*columns),
            "user_rfm_dimension": job.dimension,
            "user_rfm_segment": job.segment,
            "crm_users": job.crm_users,
        }
        stored = {name: write(table, name) for name, table in made.items()}
    return reports.segment_check(stored["crm_users"])


def publish(sources: Sources, rules: Rules, store: Releases, labels: str = "v3") -> dict[str, int]:
    """Build the four tables as one release of `store`, and make it the current one.

    Each table is written once, in its place, and the next are built from what was written. If any
    part fails nothing is published and the tables of the release before stay as they are. Rows that
    the inputs' contracts set aside are published as `rejected_rows`. Returns the facts that are
    stored with the release, all counted while its tables were written: rows of every table, users
    without a label, buyers, order documents, unread ones, and repeated keys of lookups.

    Shuffles start as wide as the inputs of the session's default need; the setting is put back.
    """
    spark = sources.users.sparkSession
    job = Segmentation(sources, rules, labels=labels)
    job.lookups = Lookups(rules.fail_on_repeated_keys, count=True)
    columns = ["user_id", "r_raw", "f_raw", "m_raw", "r_score", "f_score", "m_score"]
    unlabelled = F.count_if(F.col("dimension_label").isNull())
    buyer = F.col("r_score").isNotNull()
    with fitted_shuffles(spark, sources.sized()), temporary_stages(spark), store.begin() as release:
        score = release.write(job.score.select(*columns), "user_rfm_score")
        job.score = score
        job.dimension = stage_by(
            release.write(job.build_dimension(), "user_rfm_dimension", unlabelled=unlabelled), "dimension", "user_id"
        )
        release.write(job.build_segment(), "user_rfm_segment", unlabelled=unlabelled)
        release.write(
            job.build_crm(),
            "crm_users",
            buyers=F.count_if(buyer),
            unlabelled=F.count_if(buyer & F.col("dimension_label").isNull()),
        )
        if labels == "v3":
            release.facts |= {f"commerce_orders.{k}": v for k, v in job.documents.get.items()}
        release.facts |= {f"{table}.repeated": n for table, n in job.lookups.repeated.items()}
        rejected = sources.rejected()
        if rejected is not None:
            release.write(rejected, "rejected_rows")
    return release.facts


def write_reports(
    segment: DataFrame,
    customers: DataFrame,
    personas: DataFrame,
    actions: DataFrame,
    write: Writer,
    job: Segmentation | None = None,
) -> dict[str, DataFrame]:
    """Store the reports on a stored segment and customer table; each replaces the last one.

    Each of the two tables is read once for all its reports. Overall totals and the winner rate need
    the inputs too: they are stored if `job` is given, and the winner rate then reads its label's
    customers once more.
    """
    with temporary_stages(segment.sparkSession):
        tables = reports.segment_reports(segment)
        summary = write(tables.pop("summary"), "report_summary")
        tables |= {
            "total_users": reports.total_users(summary),
            "personas": reports.persona_scorecard(summary, personas),
            "actions": reports.planned_actions(summary, actions),
            **reports.customer_reports(customers),
        }
        if job is not None:
            tables["kpi_totals"] = job.kpi_totals()
            tables["winner_rate"] = reports.winner_rate(customers, job.winners)
        stored = {name: write(table, f"report_{name}") for name, table in tables.items()}
    return {"summary": summary, **stored}


def parquet_writer(root: str) -> Writer:
    """Store tables as parquet folders below `root`.

    A table is written whole beside the old one and then takes its place, so a failed write leaves
    the old one as it is.
    """

    def write(df: DataFrame, name: str) -> DataFrame:
        spark = df.sparkSession
        fresh = f"{root}/_{name}-{uuid.uuid4().hex}"
        new, old = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (fresh, f"{root}/{name}"))
        files = new.getFileSystem(spark._jsc.hadoopConfiguration())
        try:
            df.write.parquet(fresh)
        except Exception:
            files.delete(new, True)
            raise
        files.delete(old, True)
        if not files.rename(new, old):
            raise OSError(f"cannot rename {fresh} to {root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    return write


def table_writer(database: str) -> Writer:
    """Store tables in a database of the session catalog, each written whole before it replaces
    the old one."""

    def write(df: DataFrame, name: str) -> DataFrame:
        spark = df.sparkSession
        fresh = f"{database}.{name}_{uuid.uuid4().hex}"
        try:
            df.write.saveAsTable(fresh)
        except Exception:
            spark.sql(f"DROP TABLE IF EXISTS {fresh}")
            raise
        spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")
        spark.sql(f"ALTER TABLE {fresh} RENAME TO {database}.{name}")
        return spark.table(f"{database}.{name}")

    return write
