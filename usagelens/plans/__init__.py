"""The reports: plans over the account-usage tables."""
