"""klangsieb: curation, sampling, scoring and reporting for speech and text corpora on Spark."""
