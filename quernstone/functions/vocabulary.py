"""Fixed vocabularies of the case records: products, splits, outcomes. Fixed values, stated as the results require them."""

from __future__ import annotations

# Which raw product labels stand for a product. One retired label stands for two.
PRODUCT_LABELS: dict[str, list[str]] = {
    "credit_card": ["Credit card", "Credit card or prepaid card"],
    "prepaid_card": ["Prepaid card", "Credit card or prepaid card"],
    "checking_savings": ["Checking or savings account"],
    "money_transfer": ["Money transfer, virtual currency, or money service"],
}
RETIRED_LABEL = "Credit card or prepaid card"

# Sub-products of each product; none is listed under two.
SUB_PRODUCTS: dict[str, list[str]] = {
    "credit_card": ["General-purpose credit card or charge card", "Store credit card"],
    "prepaid_card": ["General-purpose prepaid card", "Government benefit card", "Gift card", "Payroll card", "Student prepaid card"],
    "checking_savings": ["Checking account", "Savings account", "Other banking product or service", "CD (Certificate of Deposit)"],
    "money_transfer": [
        "Mobile or digital wallet", "Domestic (US) money transfer", "Virtual currency", "International money transfer", "Money order, traveler's check or cashier's check",
        "Check cashing service", "Foreign currency exchange", "Refund anticipation check", "Debt settlement", "Traveler's check or cashier's check", "Money order",
    ],
}

# Splits by day received, both ends inclusive.
SPLITS: list[tuple[str, str, str]] = [
    ("train", "2021-01-01", "2024-12-31"),
    ("excluded", "2025-01-01", "2025-02-28"),
    ("validation", "2025-03-01", "2025-06-30"),
    ("test", "2025-07-01", "2025-12-31"),
]
OUT_OF_RANGE = "out_of_range"
EVAL_SPLITS = ["validation", "test"]

# The label that a recorded outcome stands for.
LABELS: dict[str, str] = {
    "Closed with explanation": "no_relief",
    "Closed with monetary relief": "needed_human",
    "Closed with non-monetary relief": "needed_human",
    "Untimely response": "excluded",
    "In progress": "excluded",
}

# Words of firms' names that identify none of them.
GENERIC_WORDS = (
    "inc llc na corp company bank the and of co group financial services holdings usa us national association fsb sa plc trust credit union first one american america"
).split()
