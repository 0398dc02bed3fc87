"""gridwatch: spatio-temporal incident analytics on Spark DataFrames.

Main entry points (all take and return DataFrames):

* typing / cleaning:  ``operators.clean.type_incidents``, ``quarantine``, ``csv_to_typed``
* fact table:         ``operators.facts.fact_first_wins``, ``incident_last_wins``
* graph:              ``operators.graph.graph_input``, ``location_nodes``, ``edges_all``, ``graph_stats``
* risk:               ``operators.risk.risk_scores``, ``risk_at_hour``, ``risk_by_part``
* spatial:            ``operators.spatial.proximity_join``, ``operators.proximity.occurred_near``,
                      ``near_incident_pairs``, ``within_radius``
* prediction:         ``operators.predict.grid_scores``, ``evidence``, ``top_cells_geojson``
* streaming:          ``streaming.runner.run_incidents``, ``run_incidents_stateful``,
                      ``streaming.near.run_near_stream``, ``streaming.windows.window_counts``
* session:            ``session.build_session``, ``shared_path``, ``cut_lineage``
"""

__version__ = "0.1.0"
