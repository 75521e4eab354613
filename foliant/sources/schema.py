"""Schema of records: pages and regions, with the fields that enrichment and other dialects add. All fields may be null."""

RECORD = (
    "record_id string, document_id string, page_id string, region_id string, unit_type string, bbox array<int>, reading_order int, source_type string, title string, date_created string,"
    "language array<string>, retrieval_text string,"
    "ocr struct<full_text:string,keywords:array<string>,language:string,engine:string,confidence_score:double,word_confidences:array<struct<text:string,confidence:double>>>,"
    "summary struct<short_description:string,keywords:array<string>>, entities array<struct<entity_type:string,text:string,count:int>>,"
    "visual_marks array<struct<mark_id:string,mark_type:string,subtype:string,description:string,bbox:array<int>,confidence_score:double,verification_status:string>>,"
    "linked_text_spans array<struct<span_id:string,mark_id:string,region_id:string,text:string,iou:double>>,"
    "forensic_flags struct<verification_status:string,alerts:array<string>,human_review_required:boolean,confidence_score:double,uncertainty_state:string>,"
    "provenance struct<pipeline_version:string,model_outputs:map<string,string>,created_at:string,source_image_path:string>,"
    "collection_id string, collection_name string, creator array<string>, contributors array<string>, rights string, schema_version string,"
    "archival_metadata struct<fonds:string,series:string,epoch:string,call_number:string,institution:string,repository:string>, physical_metadata struct<file_name:string>,"
    "ai_metadata struct<detected_topics:array<string>>"
)
