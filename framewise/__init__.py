"""Time-tolerant joins, sequence operators, folds, matching, scorecards and graphs over DataFrames."""
