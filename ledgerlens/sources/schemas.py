"""Table registry: canonical schema, accepted header aliases, file prefix.

The alias lists, file prefixes and master file names below are fixed values:
they must equal the ones used by the files this package ingests, so they are
written out plainly, in the registry's order. Header matching is
case-insensitive and the first alias that is present wins.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import types as T


@dataclass(frozen=True)
class TableSpec:
    name: str
    aliases: dict  # canonical column -> accepted header names, in priority order
    types: dict  # canonical column -> Spark SQL type string
    master_file: str
    file_prefix: str
    extra_types: dict = field(default_factory=dict)  # derived columns stored with the table
    # Quoted line breaks keep Spark from splitting a file. None: files that have one are read whole, all others
    # in parts; True: every file is read whole; False: a file with a quoted line break is refused.
    multi_line: bool | None = None

    @property
    def columns(self) -> list[str]:
        return list(self.aliases)

    @cached_property
    def headers(self) -> dict[str, tuple[str, int]]:
        """Accepted header in lower case -> (canonical column, rank among that column's headers)."""
        return {name.lower(): (column, rank) for column, names in self.aliases.items() for rank, name in enumerate(names)}

    def struct(self, with_extra: bool = True) -> T.StructType:
        cols = dict(self.types)
        if with_extra:
            cols.update(self.extra_types)
        return T.StructType([T.StructField(c, T._parse_datatype_string(t), True) for c, t in cols.items()])


# --- fixed values: header aliases per canonical column -------------------------------
SALES_ALIASES = {
    "orderid": ["OrderID", "order_id"],
    "timestamp": ["Timestamp", "order_date"],
    "productid": ["ProductID", "product_sku"],
    "productname": ["ProductName"],
    "category": ["Category"],
    "quantity": ["Quantity", "qty"],
    "grossvalue": ["GrossValue"],
    "discountvalue": ["DiscountValue"],
    "costofgoodssold": ["CostOfGoodsSold", "cogs"],
    "customerid": ["CustomerID", "user_id"],
    "city": ["City", "store_city"],
    "locationid": ["LocationID", "store_id"],
    "channel": ["Channel"],
    "orderstatus": ["OrderStatus", "status"],
}
DELIVERY_ALIASES = {
    "deliveryid": ["DeliveryID"],
    "orderid": ["OrderID"],
    "orderdate": ["OrderDate"],
    "promiseddate": ["PromisedDate"],
    "actualdeliverydate": ["ActualDeliveryDate"],
    "status": ["Status"],
    "deliverypartner": ["DeliveryPartner"],
    "city": ["City"],
    "deliverycost": ["DeliveryCost"],
}
CUSTOMER_ALIASES = {
    "customerid": ["CustomerID"],
    "joindate": ["JoinDate"],
    "city": ["City"],
    "segment": ["Segment"],
}
FUNNEL_ALIASES = {
    "week": ["Week"],
    "visits": ["Visits"],
    "carts": ["Carts"],
    "orders": ["Orders"],
}
COMPETITOR_ALIASES = {
    "date": ["Date"],
    "competitor": ["Competitor"],
    "productid": ["ProductID"],
    "productname": ["ProductName"],
    "price": ["Price"],
    "onpromotion": ["OnPromotion"],
}
CAMPAIGN_ALIASES = {
    "campaignid": ["CampaignID"],
    "campaignname": ["CampaignName"],
    "channel": ["Channel"],
    "startdate": ["StartDate"],
    "enddate": ["EndDate"],
    "totalcost": ["TotalCost"],
    "impressions": ["Impressions"],
    "clicks": ["Clicks"],
}
ATTRIBUTION_ALIASES = {
    "orderid": ["OrderID"],
    "campaignid": ["CampaignID"],
}
# --- end of fixed values ----------------------------------------------------------------

SALES_TYPES = {
    "orderid": "string", "timestamp": "timestamp_ntz", "productid": "string", "productname": "string",
    "category": "string", "quantity": "int", "grossvalue": "decimal(18,2)", "discountvalue": "decimal(18,4)",
    "costofgoodssold": "decimal(18,4)", "customerid": "string", "city": "string", "locationid": "string",
    "channel": "string", "orderstatus": "string",
}
DELIVERY_TYPES = {
    "deliveryid": "string", "orderid": "string", "orderdate": "date", "promiseddate": "date",
    "actualdeliverydate": "date", "status": "string", "deliverypartner": "string", "city": "string",
    "deliverycost": "decimal(10,2)",
}
CUSTOMER_TYPES = {"customerid": "string", "joindate": "timestamp_ntz", "city": "string", "segment": "string"}
FUNNEL_TYPES = {"week": "date", "visits": "bigint", "carts": "bigint", "orders": "bigint"}
COMPETITOR_TYPES = {
    "date": "date", "competitor": "string", "productid": "string", "productname": "string",
    "price": "decimal(10,2)", "onpromotion": "boolean",
}
CAMPAIGN_TYPES = {
    "campaignid": "string", "campaignname": "string", "channel": "string", "startdate": "date",
    "enddate": "date", "totalcost": "decimal(18,2)", "impressions": "bigint", "clicks": "bigint",
}
ATTRIBUTION_TYPES = {"orderid": "string", "campaignid": "string"}
PREDICTION_TYPES = {"customerid": "string", "churn_probability": "double"}

# Registry order matters: a file is routed to the first table whose prefix matches.
# Table name, master file name and incoming-file prefix.
REGISTRY: dict[str, TableSpec] = {
    "sales": TableSpec("sales", SALES_ALIASES, SALES_TYPES, "sales_data.csv", "sales_",
                       extra_types={"netsale": "decimal(19,4)"}),
    "deliveries": TableSpec("deliveries", DELIVERY_ALIASES, DELIVERY_TYPES, "delivery_data.csv", "delivery_"),
    "customers": TableSpec("customers", CUSTOMER_ALIASES, CUSTOMER_TYPES, "customer_data.csv", "customer_"),
    "sales_funnel": TableSpec("sales_funnel", FUNNEL_ALIASES, FUNNEL_TYPES, "funnel_data.csv", "funnel_"),
    "marketing_campaigns": TableSpec("marketing_campaigns", CAMPAIGN_ALIASES, CAMPAIGN_TYPES,
                                     "marketing_campaigns.csv", "campaigns_"),
    "marketing_attribution": TableSpec("marketing_attribution", ATTRIBUTION_ALIASES, ATTRIBUTION_TYPES,
                                       "marketing_attribution.csv", "attribution_"),
}

# Competitor prices arrive and are rebuilt like the rest; views list them apart from the business tables.
COMPETITORS = TableSpec("competitors", COMPETITOR_ALIASES, COMPETITOR_TYPES, "competitor_data.csv", "competitor_")
INGESTED: dict[str, TableSpec] = {**REGISTRY, COMPETITORS.name: COMPETITORS}

PREDICTIONS_TABLE = "customer_churn_predictions"
PREDICTIONS = TableSpec(PREDICTIONS_TABLE, {}, PREDICTION_TYPES, "", "")


def spec_for(name: str) -> TableSpec | None:
    return PREDICTIONS if name == PREDICTIONS_TABLE else INGESTED.get(name)


def empty_frame(spark, name: str):
    """Empty DataFrame with the declared schema of a table (no columns if the name is unknown)."""
    spec = spec_for(name)
    return spark.createDataFrame([], spec.struct() if spec else T.StructType([]))
