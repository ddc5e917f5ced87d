"""Import every query module so the registry is complete."""
from touchline.plans import q_backtest, q_coupons, q_evaluate, q_features, q_ingest, q_markets, q_model, q_sync  # noqa: F401
from touchline.plans.registry import ORACLES, QUERIES  # noqa: F401
