"""Column types of the normalised logs and of stored rows."""

from __future__ import annotations

# data type -> DDL of its normalised frame.
EVENTS = {
    "network_connections": (
        "source_ip string, destination_ip string, source_port int, destination_port int, protocol string, "
        "bytes_in bigint, bytes_out bigint, conn_state string, sensor_id string, vlan string, timestamp timestamp"
    ),
    "dns_queries": "source_ip string, domain string, response_code string, answer string, sensor_id string, vlan string, timestamp timestamp",
    "ntlm_logs": (
        "source_ip string, dest_ip string, hostname string, domainname string, server_nb_computer_name string, "
        "server_dns_computer_name string, sensor_id string, vlan string, timestamp timestamp"
    ),
    "http_requests": "source_ip string, destination_ip string, method string, uri string, host string, user_agent string, timestamp timestamp",
    "authentication_logs": "username string, source_ip string, target_hostname string, result string, logon_type string, country string, timestamp timestamp",
    "process_logs": "hostname string, user string, process_name string, command_line string, parent_process string, timestamp timestamp",
    "powershell_logs": "hostname string, user string, command_line string, timestamp timestamp",
    "file_operations": "hostname string, user string, filename string, operation string, timestamp timestamp",
    "scheduled_tasks": "hostname string, task_name string, command string, event_type string, creator string, timestamp timestamp",
    "registry_changes": "hostname string, user string, key_path string, value_name string, value_data string, timestamp timestamp",
    "suricata_alerts": (
        "timestamp timestamp, signature string, category string, severity int, src_ip string, dest_ip string, "
        "src_port int, dest_port int, protocol string"
    ),
    "initial_signals": "type string, confidence double, description string, category string, indicators array<string>",
}

PACKETS = "src string, dst string, sport int, dport int, proto string, flags int, length bigint, time double, payload string"

EVE = (
    "event_type string, timestamp string, src_ip string, dest_ip string, src_port int, dest_port int, proto string, "
    "alert struct<signature:string,category:string,severity:int>, _corrupt_record string"
)

NODE = (
    "sensor_id string, vlan string, ip string, node_id string, total_connections bigint, bytes_sent bigint, "
    "bytes_received bigint, out_degree bigint, in_degree bigint, first_seen timestamp, last_seen timestamp, "
    "is_internal boolean, services array<struct<port:int,protocol:string>>, roles array<string>, "
    # names and identity
    "hostnames array<string>, netbios_names array<string>, domain string, host_id string, mac_address string, vendor string, "
    "virtual_platform string, is_virtual boolean, os_info string, device_model string, device_type string, "
    "software array<string>, user_agents array<string>, "
    # leases, remote desktop, encrypted traffic
    "dhcp_hostname string, dhcp_client_fqdn string, dhcp_vendor_class string, dhcp_domain string, rdp_name string, rdp_build int, "
    "rdp_info struct<cookie:string,client_build:int,client_name:string,keyboard_layout:string,resolution:string,security_protocol:string>, "
    "ja3_fingerprints array<string>, ja3s_fingerprints array<string>, tls_server_names array<string>, tls_versions_seen array<string>, "
    "cert_subjects array<string>, cert_issuers array<string>, "
    # other protocols
    "dns_profile struct<query_count:bigint,unique_domains:bigint,nxdomain_ratio:double,top_tlds:array<string>,query_types:array<string>>, "
    "file_mime_types array<string>, known_services_names array<string>, tunnel_info array<string>, ntp_server boolean, radius_server boolean, "
    "mqtt_info struct<unique_clients:bigint,actions:array<string>>, ics_protocols array<string>, notices array<string>, "
    "traceroute_hops array<string>, "
    # traffic shape and gateway evidence
    "port_count bigint, ports array<int>, unique_clients bigint, unique_destinations bigint, outgoing_count bigint, "
    "gateway_evidence array<string>, is_gateway_for array<string>"
)

CASE_FEED = (
    "case_id bigint, case_name string, case_description string, case_severity_id int, case_status_id int, "
    "case_tags string, classification string, case_open_date string, modification_date string"
)
