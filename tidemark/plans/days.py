"""Calendar-day columns of the registered queries.

The standard tables store days as midnight timestamps; results follow them, so that
days look the same whichever engine or client reads them.
"""

DAYS: dict[str, tuple[str, ...]] = {
    "b4_clean_orders": ("o_orderdate",),
    "c5_key_by_period_spine": ("period",),
    "d18_coarser_fact": ("month",),
    "d19_daily_mart": ("order_day",),
    "e3_running_total": ("day",),
    "e4_moving_average": ("day",),
    "e5_moving_days": ("day",),
    "e6_deltas": ("day",),
    "e7_year_over_year": ("day",),
    "e8_known_values": ("day",),
    "e10_rolling_ratio": ("day",),
    "e11_rows_vs_range": ("month",),
    "h4_periods": ("week", "month", "quarter", "year"),
    "h5_date_arithmetic": ("plus10", "next_month", "month_end"),
    "h6_local_period": ("local_day",),
    "i13_volume_by_period": ("period",),
    "i14_missing_periods": ("period",),
    "j26_suite_trend": ("day",),
    "j27_slo": ("day",),
    "k7_additivity": ("month",),
    "l8_seasonal_naive": ("day",),
    "l9_sigma_anomalies": ("day",),
    "l9_mad_anomalies": ("day",),
    "l10_decomposition": ("day",),
    "l10_robust_decomposition": ("day",),
    "l11_volume_anomaly": ("day",),
    "l14_naive_interval": ("day",),
    "m1_dim_date": ("date",),
    "m14_periodic_snapshot": ("day",),
    "m22_semi_additive": ("week",),
    "n9_resume_batches": ("month",),
    "n11_medallion_run": ("month",),
    "o2_month_to_date": ("day",),
    "o2_quarter_to_date": ("day",),
    "o2_year_to_date": ("day",),
    "o3_fiscal_year_to_date": ("day",),
    "o4_vs_prior_year": ("day",),
    "o4_vs_prior_week": ("day",),
    "o4_vs_prior_month": ("month",),
    "o5_trailing_12_months": ("month",),
    "o5_trailing_30_days": ("day",),
    "o7_balances": ("period",),
    "o8_measure_variants": ("month",),
    "o16_ratio_change": ("period",),
    "o17_seasonal_baseline": ("month",),
    "p2_rfm": ("as_of",),
    "p4_cohort_retention": ("cohort",),
    "r3_user_features": ("as_of",),
    "r4_churn_labels": ("as_of",),
    "r8_forecast_baselines": ("day",),
    "w6_indexed_series": ("month",),
}
