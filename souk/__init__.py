"""souk: marketplace analytics on Spark.

Base tables -> customer and seller 360 marts -> RFM, labels and forecasts ->
live re-scoring from order events -> write-back, alerts and reports.
"""
