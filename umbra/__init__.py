"""Umbra: privacy engineering (anonymisation, disclosure risk, attacks, DP) as Spark plans."""
