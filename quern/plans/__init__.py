from quern.plans.ranks import dense_positions

__all__ = ["dense_positions"]
