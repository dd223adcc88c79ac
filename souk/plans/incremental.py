"""Refresh by change: new orders update the marts of the keys they touch.

Each side (customers, sellers) keeps mergeable states of its orders, appended
batch by batch, and its marts in buckets of the key.  A batch reads its own
orders, the states and old mart rows of the buckets it touches, and replaces
those buckets; base orders are read once, when the states are started.  States
are told apart by batch, so running a batch again changes nothing.

Quintiles rank all customers against each other, so every batch ranks anew:
over four narrow columns of the mart, not over orders.  The customer forecast
follows for the buckets in which a customer was touched or a score moved.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.functions.nulls import or_zero, pct
from souk.operators.joins import split_join
from souk.operators.mergeable import (
    Bits,
    Cells,
    Measures,
    amount,
    known,
    least,
    most,
    rows_with,
    total,
)
from souk.plans import enrichment, forecast_customer, forecast_seller, gold_customer, gold_seller, rfm
from souk.sources.buckets import BUCKETS, Bucketed, touched
from souk.sources.store import Store


def _payment(*names: str) -> Column:
    return F.lower("payment_type").isin(*names)


def _order_measures(cards: list[str], cod: Column) -> dict[str, tuple[str, Column]]:
    """What both sides add up over their orders."""
    return {
        "n": rows_with(F.lit(True)),
        **{f"{c}_sum": amount(c) for c in ("order_value", "discount_amount", "refund_amount", "margin", "profit")},
        **{f"{c}_n": known(c) for c in ("order_value", "quantity", "delivery_time_days", "customer_rating", "margin")},
        **{f"{c}_sum": total(c) for c in ("quantity", "delivery_time_days", "customer_rating")},
        "value_min": least("order_value"),
        "value_max": most("order_value"),
        "date_min": least("order_date"),
        "date_max": most("order_date"),
        "returns": rows_with("is_returned"),
        "cancellations": rows_with("is_cancelled"),
        "cod": rows_with(cod),
        "upi": rows_with(_payment("upi")),
        "card": rows_with(_payment(*cards)),
        "wallet": rows_with(_payment("wallet")),
        "cod_flags": rows_with("cod_flag"),
        "delivered": rows_with(F.lower("order_status") == "delivered"),
        "high_rto": rows_with("high_rto_risk_flag"),
        "fraud": rows_with("fraud_flag"),
    }


def _mean(column: str) -> Column:
    return F.col(f"{column}_sum").cast("double") / F.nullif(F.col(f"{column}_n"), F.lit(0))


def _sum(column: str) -> Column:
    return F.col(f"{column}_sum").cast("double")


@dataclass(frozen=True)
class Side:
    """The states of one kind of key over its orders."""

    key: str
    measures: Measures
    cells: Cells
    bits: Bits | None
    modes: dict[str, str]
    distincts: dict[str, str]  # of counted values
    numbers: dict[str, str]  # of numbers, by bitmap

    def states(self) -> dict[str, Measures | Cells | Bits]:
        return {"measures": self.measures, "cells": self.cells} | ({"bits": self.bits} if self.numbers else {})

    def start(self, orders: DataFrame) -> dict[str, DataFrame]:
        """The states of some orders: one pass for each kind, combined map-side."""
        return {name: state.start(orders) for name, state in self.states().items()}

    def facts(self, states: dict[str, DataFrame]) -> DataFrame:
        """Merged states side by side, one row per key."""
        merged = {name: self.states()[name].merged(df) for name, df in states.items()}
        out = merged["measures"].join(self.cells.read(merged["cells"], self.modes, self.distincts), self.key, "left")
        if self.numbers:
            out = out.join(self.bits.read(merged["bits"], self.numbers), self.key, "left")
        return out.fillna(0, [*self.distincts, *self.numbers])


def customers() -> Side:
    key = gold_customer.KEY
    modes = {
        "most_frequent_category": "category",
        "most_frequent_brand": "brand",
        "preferred_payment_type": "payment_type",
        "preferred_order_source": "order_source",
    }
    return Side(
        key,
        Measures(key, _order_measures(["card"], _payment("cod")) | {"ids": known("order_id")}),
        Cells(key, list(modes.values())),
        None,
        modes,
        {"unique_categories_purchased": "category", "unique_brands_purchased": "brand"},
        {},
    )


def sellers() -> Side:
    key = gold_seller.KEY
    columns = ["category", "brand", "payment_type"]
    return Side(
        key,
        Measures(key, _order_measures(["card", "credit card", "debit card"], F.col("cod_flag")) | {"ids": known("order_id")}),
        # Customers are counted as values: a seller's are spread over all ids, and bitmaps
        # would grow with sellers x customers instead of with orders.
        Cells(key, [*columns, "product_id", "customer_id"], null_is_value=True),
        None,
        {
            "most_sold_category": "category",
            "most_sold_brand": "brand",
            "preferred_payment_type": "payment_type",
        },
        {
            "unique_categories_sold": "category",
            "unique_brands_sold": "brand",
            "unique_products_sold": "product_id",
            "unique_customers": "customer_id",
        },
        {},
    )


def _common() -> dict[str, Column]:
    """Measures that both marts name alike, out of merged states."""
    n = F.col("n")
    return {
        "unique_orders": F.col("ids"),
        "total_order_value": _sum("order_value"),
        "avg_order_value": _mean("order_value"),
        "max_order_value": F.col("value_max"),
        "min_order_value": F.col("value_min"),
        "first_order_date": F.col("date_min"),
        "last_order_date": F.col("date_max"),
        "order_span_days": F.date_diff("date_max", "date_min"),
        "avg_items_per_order": _mean("quantity"),
        "total_returns": F.col("returns"),
        "total_cancellations": F.col("cancellations"),
        "total_refund_amount": _sum("refund_amount"),
        "cod_orders": F.col("cod"),
        "upi_orders": F.col("upi"),
        "card_orders": F.col("card"),
        "wallet_orders": F.col("wallet"),
        "cod_pct": pct(F.col("cod_flags"), n),
        "delivered_orders": F.col("delivered"),
        "high_rto_risk_orders": F.col("high_rto"),
        "fraud_flagged_orders": F.col("fraud"),
        "total_margin": _sum("margin"),
        "total_profit": _sum("profit"),
    }


def customer_facts(states: dict[str, DataFrame]) -> DataFrame:
    """As gold_customer.customer_order_facts over all orders that went into the states.

    Order ids are taken to be unique, as the write-back's ledger keeps them, so
    their number is a count.
    """
    n = F.col("n")
    named = _common() | {
        "total_orders": n,
        "total_discount_amount": _sum("discount_amount"),
        "total_items_purchased": F.col("quantity_sum"),
        "return_rate_pct": pct(F.col("returns"), n),
        "cancellation_rate_pct": pct(F.col("cancellations"), n),
        "avg_delivery_days": _mean("delivery_time_days"),
        "avg_customer_rating": _mean("customer_rating"),
    }
    side = customers()
    out = side.facts(states)
    return out.select(*[named[c].alias(c) if c in named else F.col(c) for c in gold_customer.ORDER_FACTS_KEYED])


def seller_facts(states: dict[str, DataFrame]) -> DataFrame:
    """As gold_seller.seller_order_metrics and seller_top_values over all orders of the states."""
    n, value, profit = F.col("n"), _sum("order_value"), _sum("profit")
    named = _common() | {
        "total_orders_actual": n,
        "total_discount_given": _sum("discount_amount"),
        "total_items_sold": F.col("quantity_sum"),
        "actual_return_rate_pct": pct(F.col("returns"), n),
        "actual_cancel_rate_pct": pct(F.col("cancellations"), n),
        "avg_delivery_days_actual": _mean("delivery_time_days"),
        "avg_customer_rating_actual": _mean("customer_rating"),
        "avg_margin_pct": F.round(_mean("margin"), 2),
        "profit_margin_pct": F.round(profit / F.nullif(value, F.lit(0.0)) * 100, 2),
    }
    side = sellers()
    kept = [side.key, *side.modes, *side.distincts, *side.numbers]
    return side.facts(states).select(*kept, *[col.alias(name) for name, col in named.items()])


@dataclass(frozen=True)
class Pairs:
    """How often each (seller, customer) pair occurs in the mapping."""

    def start(self, mapping: DataFrame) -> DataFrame:
        return mapping.groupBy("seller_id", "customer_id").agg(F.count("*").alias("n"))

    def merged(self, states: DataFrame) -> DataFrame:
        return states.groupBy("seller_id", "customer_id").agg(F.sum("n").alias("n"))


class Incremental:
    """States and bucketed marts of one set of base tables, brought up to date batch by batch."""

    MARTS = ("gold_customer_360", "customer_ai_360", "forecast_customer_outlook",
             "gold_seller_360", "seller_enriched", "forecast_seller_outlook")

    def __init__(self, store: Store, customers_: DataFrame, as_of: str, now: str, buckets: int = BUCKETS):
        self.store, self.people, self.as_of, self.now, self.buckets = store, customers_, as_of, now, buckets
        self.sides = {"customer": customers(), "seller": sellers()}
        self.tables: dict[str, Bucketed] = {}

    # -- first build -------------------------------------------------------
    def start(self, orders: DataFrame, mapping: DataFrame, marts: dict[str, DataFrame], sold: DataFrame | None = None) -> None:
        """States of all base orders (batch 0), and copies of the marts in buckets of their key.

        ``sold`` are the orders with their seller where these are stored; else they are joined here.
        """
        for name in self.MARTS:
            self._table(name, "seller_id" if "seller" in name else "customer_id", marts[name]).write(marts[name])
        self.rfm = self.store.replace("rfm_segments", marts["rfm_segments"])
        self._append(orders, mapping, 0, sold)

    def _table(self, name: str, key: str, like: DataFrame) -> Bucketed:
        if name not in self.tables:
            self.tables[name] = Bucketed(self.store, name, key, like.schema, self.buckets)
        return self.tables[name]

    def _append(self, orders: DataFrame, mapping: DataFrame, epoch: int, sold: DataFrame | None = None) -> None:
        sold = gold_seller.seller_orders(orders, mapping) if sold is None else sold
        parts = {"customer": self.sides["customer"].start(orders), "seller": self.sides["seller"].start(sold)}
        parts["seller"]["pairs"] = Pairs().start(mapping)
        for side, states in parts.items():
            for name, state in states.items():
                self._table(f"state_{side}_{name}", f"{side}_id", state).append(state, epoch)

    def _states(self, side: str, only: list[int]) -> dict[str, DataFrame]:
        return {n: self.tables[f"state_{side}_{n}"].read_batches(only) for n in self.sides[side].states()}

    # -- a batch -------------------------------------------------------------
    def absorb(self, orders: DataFrame, mapping: DataFrame, epoch: int) -> dict[str, list[int]]:
        """Adds a batch of new orders and brings all marts up to date; returns the buckets replaced, by mart.

        ``epoch`` numbers the batch from 1 on; the same batch again leaves everything as it is.
        """
        self._append(orders, mapping, epoch)
        run = f"batch-{epoch}"
        replaced = self._customers(orders, run) | self._sellers(mapping, run)
        return {name: buckets for name, buckets in replaced.items() if buckets}

    def mart(self, name: str) -> DataFrame:
        return self.rfm if name == "rfm_segments" else self.tables[name].read()

    def _replace(self, name: str, df: DataFrame, run: str) -> None:
        self.tables[name].replace(df, run)

    def _customers(self, orders: DataFrame, run: str) -> dict[str, list[int]]:
        new = touched(orders, "customer_id", self.buckets)
        if not new:
            return {}
        gold, ai = self.tables["gold_customer_360"], self.tables["customer_ai_360"]
        keys = orders.select("customer_id").distinct()
        states = {n: df.join(keys, "customer_id", "left_semi") for n, df in self._states("customer", new).items()}
        self._replace("gold_customer_360", refreshed_customers(gold.read(new), customer_facts(states), self.now), run)
        self._replace("customer_ai_360", enrichment.customer_ai_360(gold.read(new), self.now), run)

        scores = rfm.rfm_scores(rfm.rfm_base(gold.read(), self.as_of), self.store)
        before, self.rfm = self.rfm, self.store.replace("rfm_segments", rfm.rfm_segments(scores))
        old = before.toDF(*[f"_{c}" for c in before.columns])
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in before.columns]
        moved = self.rfm.join(old, same, "left_anti")
        changed = sorted({*new, *touched(moved, "customer_id", self.buckets)})
        forecast = forecast_customer.forecast_customer_outlook(ai.read(changed), self.rfm, self.as_of, self.now)
        self._replace("forecast_customer_outlook", forecast, run)
        return {"gold_customer_360": new, "customer_ai_360": new, "forecast_customer_outlook": changed}

    def _sellers(self, mapping: DataFrame, run: str) -> dict[str, list[int]]:
        new = touched(mapping, "seller_id", self.buckets)
        if not new:
            return {}
        gold, keys = self.tables["gold_seller_360"], mapping.select("seller_id").distinct()
        states = {n: df.join(keys, "seller_id", "left_semi") for n, df in self._states("seller", new).items()}
        pairs = self.tables["state_seller_pairs"].read_batches(new).join(keys, "seller_id", "left_semi")
        served = gold_seller.seller_customer_metrics(self.people, Pairs().merged(pairs), counted="n")
        self._replace("gold_seller_360", refreshed_sellers(gold.read(new), seller_facts(states), served, self.now), run)
        self._replace("seller_enriched", enrichment.seller_enriched(gold.read(new), self.now), run)
        enriched = self.tables["seller_enriched"].read(new)
        self._replace("forecast_seller_outlook", forecast_seller.forecast_seller_outlook(enriched, self.now), run)
        return dict.fromkeys(("gold_seller_360", "seller_enriched", "forecast_seller_outlook"), new)


def _with_new(old: DataFrame, facts: DataFrame, key: str, now: str) -> DataFrame:
    """Old rows with the columns of ``facts`` where there is a row for their key."""
    fresh = facts.select(F.col(key), F.lit(True).alias("_fresh"), *[F.col(c).alias(f"_new_{c}") for c in facts.columns if c != key])
    joined = split_join(old, fresh, key, key, how="left")
    newer = [c for c in facts.columns if c != key]
    swap = {c: F.when(F.col("_fresh"), F.col(f"_new_{c}")).otherwise(F.col(c)).cast(old.schema[c].dataType) for c in newer}
    swap["created_at"] = F.when(F.col("_fresh"), F.lit(now).cast("timestamp_ntz")).otherwise(F.col("created_at"))
    return joined.withColumns(swap).select(*old.columns)


def refreshed_customers(old: DataFrame, facts: DataFrame, now: str) -> DataFrame:
    """Customer 360 rows, those of customers with new facts brought up to date."""
    zero = [c[:-1] for c in gold_customer.ORDER_FACTS if c.endswith("*")]
    facts = facts.withColumns({c: or_zero(F.col(c)) for c in zero})
    return _with_new(old, facts, gold_customer.KEY, now).withColumns(
        {
            "combined_revenue": F.col("total_order_value") + F.col("total_marketing_conversion_value"),
            "has_ordered": F.col("total_orders") > 0,
        }
    )


def refreshed_sellers(old: DataFrame, facts: DataFrame, served: DataFrame, now: str) -> DataFrame:
    """Seller 360 rows, those of sellers with new facts brought up to date."""
    new = facts.join(served, gold_seller.KEY, "left")
    return _with_new(old, new, gold_seller.KEY, now).withColumn(
        "fraud_rate_pct", pct(F.col("fraud_flagged_orders"), F.col("total_orders_actual"))
    )
