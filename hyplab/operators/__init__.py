"""DataFrame operators: joins, scores, selection, fusion, gates, resampling."""
