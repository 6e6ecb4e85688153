"""Schemas of the files the engine reads and writes."""

BOX = "stem string, line int, cls int, xc double, yc double, w double, h double, status string"
DETECTIONS = "image string, predictions array<struct<class_id:int,confidence:double,xyxy:array<double>>>"
HASHES = "stem string, split string, width int, height int, aspect double, phash string, dhash string"
DUP_PAIRS = "group_id int, relation string, stem_a string, split_a string, boxes_a int, classes_a string, stem_b string, split_b string, boxes_b int, classes_b string, result string, conflict int"
PIXEL_METRICS = "stem_a string, split_a string, stem_b string, split_b string, relation string, exact_dimensions int, decoded_pixel_exact int, gray_corr double, gray_mae double, psnr double, color_corr double, passed_gates string"
MODEL_PREDICTIONS = "stem string, image string, fire_conf double, smoke_conf double, top_conf double, top_class string, fire_count int, smoke_count int"
HUMAN_REVIEW = "id string, category string, source_split string, image string, label string, status string, note string"
