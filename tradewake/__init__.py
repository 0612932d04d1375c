"""Real-time commerce analytics on Spark: active devices, revenue, coupon-abuse
alerts, late-arriving order joins and sale search, as DataFrame functions."""
