"""Query catalogues: modules with QUERIES and SQL."""

from millrace.plans import cleaning, contracts, customers, experiments, inference, metrics, models, pipelines, ranking, retrieval, time_series, training_data

CATALOGUES = (cleaning, contracts, customers, experiments, inference, metrics, models, pipelines, ranking, retrieval, time_series, training_data)
