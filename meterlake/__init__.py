"""Usage-ledger analytics on Spark: metered API calls from logs to priced, audited reports."""
