"""Declared schemas of the record files; nothing is inferred."""

from __future__ import annotations

PAGE = "struct<id:string,title:string,abstract:string>"
GRAPH = f"graph struct<root:string>, nodes array<struct<id:string,title:string,pages:array<{PAGE}>>>, links array<struct<source:string,target:string,weight:double>>"
CATEGORIES = "id bigint, title string, pages array<bigint>, sub_categories array<struct<id:bigint,title:string>>"
PAGES = "id bigint, title string, abstract string"
SNAPSHOT = "id string, title string, abstract string, categories string, versions array<struct<version:string,created:string>>"
PAPERS = "id string, title string, categories array<string>, abstract string, date timestamp"
CITED_PAPERS = f"{PAPERS}, citation_count int"
SAMPLES = "id string, title string, abstract string, paths array<array<string>>"
PATH_OUTPUTS = "id string, title string, abstract string, hierarchy string, few_shot_ids array<string>, description string"
CONCEPT_OUTPUTS = "id string, title string, abstract string, concepts string"
TRIPLET = "struct<head:string,type:string,tail:string>"
TRIPLET_OUTPUTS = f"id string, title string, abstract string, triplets array<{TRIPLET}>"
SETTINGS = "struct<absolute_percentile:double,relative_percentile:double,remove_self_loops:boolean,remove_inverse_edges:boolean,prune_unconnected_nodes:boolean,add_root:boolean>"
SWEEP = f"edge_soft_precision double, edge_soft_recall double, edge_soft_f1 double, edge_hard_precision double, edge_hard_recall double, edge_hard_f1 double, hp {SETTINGS}"
SCORED_PAIRS = "hypo string, hyper string, sim double, is_oov string"
EDGES = "src string, dst string, weight double"
VERTICES = f"id string, title string, pages array<{PAGE}>"
